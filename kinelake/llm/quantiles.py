"""Percentiles of very many readings from dyadic Count-sketches.

A reading becomes an order-preserving code of 24 bits (sign, exponent and 15
bits of the fraction: values are told apart to a relative 2**-15). Below the
top 14 bits, which are counted as they are, each binary resolution has a
signed Count-sketch of ``DEPTH`` rows. Sketches are linear: those of parts,
days or files are merged by addition, and a negative weight takes readings
out. A rank is inverted by descending the levels.

A partial result with few distinct codes travels as its codes and counts,
which is the same sketch written shorter; it is hashed once it grows.

Results are exact to the code where a group has no more than ``SPARSE``
distinct codes. Else each comes with ``rank_error``, the bound of its rank's
error as a share of the readings, from the sketch itself: a level adds an error
of variance F2 / (2 WIDTH), F2 the sum of squared counts that are left without
the ``HEAVY`` largest cells of a row (what is alone in a cell is found by the
median of the rows), the median of three rows has 0.67 of one's deviation, and
the bound is ``SIGMAS`` deviations of the sum: it fails about once in 30,000
percentiles. ``RANK_ERROR`` is what it stays below for readings as they come.

Defined results: null, NaN, infinite and cut-off readings are left out; groups
without a finite reading have no row; -0.0 is 0.0; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.vectors import matrix
from kinelake.session import written

BITS, TOP, DEPTH, WIDTH, SPARSE = 24, 14, 3, 1024, 8192
LEVELS = BITS - TOP
RANK_ERROR = 0.01
HEAVY, SIGMAS = 32, 4.2
HELD = 256 << 20  # bytes of sketches that a task holds before it hands them on
# one odd multiplier and one offset per level and row, from a fixed seed
_R = np.random.default_rng(20240229)
_A = _R.integers(1, 2**62, (LEVELS, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, (LEVELS, DEPTH), dtype=np.uint64)


def encode(values: np.ndarray) -> np.ndarray:
    """Order-preserving codes of finite values, as float32."""
    bits = (values.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)) >> np.uint32(32 - BITS)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the values of a code."""
    full = (codes.astype(np.uint32) << np.uint32(32 - BITS)) | np.uint32(1 << (31 - BITS))
    bits = np.where(full >> 31, full & np.uint32(0x7FFFFFFF), ~full)
    out = bits.astype(np.uint32).view(np.float32).astype(np.float64)
    # zero has a code whose middle is a tiny number
    return np.where(np.abs(out) < 1e-37, 0.0, out)


def _cells(level: int, row: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = (prefix.astype(np.uint64) + np.uint64(1)) * _A[level, row] + _B[level, row]
        h ^= h >> np.uint64(29)
        h = h * _A[level, row - 1]
    return (h >> np.uint64(40)).astype(np.int64) % WIDTH, 1 - 2 * ((h >> np.uint64(39)) & np.uint64(1)).astype(np.int64)


class Sketch:
    """The readings of one group: codes and counts, or the hashed levels."""

    __slots__ = ("n", "codes", "counts", "top", "table")

    def __init__(self) -> None:
        self.n = 0.0
        self.codes, self.counts = np.empty(0, np.uint32), np.empty(0)
        self.top = self.table = None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Distinct codes and their counts, which may be negative or parts of one."""
        self.n += float(counts.sum())
        if self.table is None:
            both, where = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
            total = np.bincount(where, np.concatenate([self.counts, counts]), len(both))
            keep = np.abs(total) > 1e-9
            self.codes, self.counts = both[keep].astype(np.uint32), total[keep]
            if len(self.codes) <= SPARSE:
                return
            codes, counts = self.codes, self.counts
            self.codes, self.counts = np.empty(0, np.uint32), np.empty(0)
            self.top, self.table = np.zeros(1 << TOP), np.zeros((LEVELS, DEPTH, WIDTH))
        order = np.argsort(codes)
        prefix, weight = codes[order].astype(np.int64), counts[order].astype(float)
        for level in range(LEVELS):
            for row in range(DEPTH):
                at, sign = _cells(level, row, prefix)
                self.table[level, row] += np.bincount(at, sign * weight, WIDTH)
            prefix >>= 1
            first = np.flatnonzero(np.diff(prefix, prepend=-1))
            prefix, weight = prefix[first], np.add.reduceat(weight, first) if len(first) else weight
        self.top += np.bincount(prefix, weight, 1 << TOP)

    def merge(self, other: Sketch) -> None:
        if other.table is None:
            self.add(other.codes, other.counts)
            return
        if self.table is None:
            codes, counts = self.codes, self.counts
            self.n, self.top, self.table = other.n, other.top.copy(), other.table.copy()
            self.codes, self.counts = np.empty(0, np.uint32), np.empty(0)
            if len(codes):
                self.add(codes, counts)
            return
        self.n += other.n
        self.top += other.top
        self.table += other.table

    def dump(self) -> bytes:
        if self.table is None:
            planes = np.concatenate([np.diff(self.codes, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel(), self.counts.astype("<f8").view(np.uint8).reshape(-1, 8).T.ravel()])
            return b"s" + zlib.compress(planes.tobytes(), 1)
        flat = np.concatenate([self.top, self.table.ravel()]).astype("<f8")
        return b"d" + zlib.compress(flat.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)

    @classmethod
    def load(cls, raw: bytes) -> Sketch:
        self, planes = cls(), np.frombuffer(zlib.decompress(raw[1:]), np.uint8)
        if raw[:1] == b"s":
            n = len(planes) // 12
            self.codes = np.cumsum(np.ascontiguousarray(planes[: 4 * n].reshape(4, n).T).view("<u4").ravel()).astype(np.uint32)
            self.counts = np.ascontiguousarray(planes[4 * n :].reshape(8, n).T).view("<f8").ravel()
            self.n = float(self.counts.sum())
        else:
            flat = np.ascontiguousarray(planes.reshape(8, -1).T).view("<f8").ravel()
            self.top, self.table = flat[: 1 << TOP].copy(), flat[1 << TOP :].reshape(LEVELS, DEPTH, WIDTH).copy()
            self.n = float(self.top.sum())
        return self

    def _estimate(self, level: int, prefix: int) -> float:
        p = np.array([prefix])
        found = []
        for row in range(DEPTH):
            at, sign = _cells(level, row, p)
            found.append(float(self.table[level, row, at[0]] * sign[0]))
        return float(np.median(found))

    def quantile(self, q: float) -> float | None:
        """The smallest value whose rank reaches ``q`` of the readings."""
        n = round(self.n)
        if n <= 0:
            return None
        rank = min(max(int(np.ceil(q * n - 1e-9)), 1), n) - 0.5  # between two ranks, so that parts of counts need not add up to the last digit
        if self.table is None:
            return float(decode(self.codes[[np.searchsorted(np.cumsum(self.counts), rank)]])[0])
        before = np.cumsum(self.top)
        node = int(np.searchsorted(before, rank))
        rank -= before[node] - self.top[node]
        size = float(self.top[node])
        for level in range(LEVELS - 1, -1, -1):
            left, right = self._estimate(level, 2 * node), self._estimate(level, 2 * node + 1)
            # both children estimate the split of a parent of known size
            share = min(max((left + size - right) / 2, 0.0), size)
            if rank <= share:
                node, size = 2 * node, share
            else:
                node, size, rank = 2 * node + 1, size - share, rank - share
        return float(decode(np.array([node]))[0])

    def rank_error(self) -> float:
        """The bound of the error of a rank, as a share of the readings; 0 where codes are kept."""
        if self.table is None or self.n <= 0:
            return 0.0
        light = np.sort(self.table**2, axis=2)[:, :, :-HEAVY].sum(2) * 1.2  # what light readings have in the cells left out
        return float(SIGMAS * 0.67 * np.sqrt(np.median(light, axis=1).sum() / (2 * WIDTH)) / self.n)

    def size(self) -> int:
        return 12 * len(self.codes) if self.table is None else self.top.nbytes + self.table.nbytes


def sketches(rows: DataFrame, keys: list[str], vectors: list[str], weight: str | None = None, salts: int = 64) -> DataFrame:
    """(keys, vector, dim, n, sketch) of all finite readings in list columns.

    Each task sketches its own rows, and hands on what it holds whenever that
    exceeds ``HELD`` bytes; partial sketches of a group are added first by salt
    where there are many tasks, then by group.
    """
    kinds = dict(rows.dtypes)
    picked = rows.select(*keys, *vectors, *([weight] if weight else []))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "vector string, dim int, n double, sketch binary"])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        values: list[dict] = []  # the key values of each number
        number: dict[tuple, int] = {}
        types = None
        waiting: dict[tuple, list] = {}
        size = 0

        def settle() -> None:
            for key, parts in waiting.items():
                codes = np.concatenate([p[0] for p in parts])
                w = np.concatenate([p[1] for p in parts])
                unique, where = np.unique(codes, return_inverse=True)
                held.setdefault(key, Sketch()).add(unique, np.bincount(where, w, len(unique)))
            waiting.clear()

        def handed() -> Iterator[pa.RecordBatch]:
            names = list(held)
            if not names:
                return
            columns = [pa.array([values[n][k] for n, _, _ in names], ty) for k, ty in zip(keys, types)]
            rest = [pa.array([v for _, v, _ in names], pa.string()), pa.array([d for _, _, d in names], pa.int32()), pa.array([s.n for s in held.values()], pa.float64())]
            for a in range(0, len(names), 64):
                blob = pa.array([held[k].dump() for k in names[a : a + 64]], pa.binary())
                yield pa.record_batch([*(c.slice(a, 64) for c in [*columns, *rest]), blob], [*keys, "vector", "dim", "n", "sketch"])
            held.clear()
            number.clear()
            values.clear()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            types = [t.schema.field(k).type for k in keys]
            code = np.zeros(t.num_rows, np.int64)
            for k in keys:
                d = t.column(k).combine_chunks().dictionary_encode()
                code = code * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(len(d.dictionary))).astype(np.int64)
            groups, first, member = np.unique(code, return_index=True, return_inverse=True)
            named = []
            for f in first:
                key = tuple(t.column(k)[int(f)].as_py() for k in keys)
                named.append(number.setdefault(key, len(number)))
                if len(values) < len(number):
                    values.append(dict(zip(keys, key)))
            each = np.ones(t.num_rows) if weight is None else np.asarray(t.column(weight).combine_chunks()).astype(float)
            for vector in vectors:
                column = t.column(vector).combine_chunks()
                for g, name in enumerate(named):
                    pick = np.flatnonzero(member == g)
                    m = matrix(column.take(pa.array(pick)) if len(groups) > 1 else column)
                    for dim in range(m.shape[1]):
                        with np.errstate(over="ignore"):
                            x = m[:, dim].astype(np.float32)
                        ok = np.isfinite(x)
                        if ok.any():
                            waiting.setdefault((name, vector, dim), []).append((encode(x[ok]), each[pick][ok]))
                            size += int(ok.sum())
            if size > 2_000_000:
                settle()
                size = 0
                if sum(s.size() for s in held.values()) > HELD:
                    yield from handed()
        settle()
        yield from handed()

    parts = picked.mapInArrow(build, schema)
    many = rows.rdd.getNumPartitions() > 4 * salts
    if many:
        parts = merge(parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))), [*keys, "vector", "dim", "_salt"]).drop("_salt")
    return merge(parts, [*keys, "vector", "dim"])


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches with equal keys, added up; those of days or files give those of all."""
    kinds = dict(parts.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n double, sketch binary"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, types, total = None, None, Sketch()

        def out():
            return pa.record_batch([*(pa.array([v], t) for v, t in zip(now, types)), pa.array([total.n], pa.float64()), pa.array([total.dump()], pa.binary())], [*keys, "n", "sketch"])

        for batch in batches:
            types = types or [batch.schema.field(k).type for k in keys]
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            blob = batch.column(batch.schema.get_field_index("sketch"))
            for i, key in enumerate(zip(*columns)):
                if key != now:
                    if now is not None:
                        yield out()
                    now, total = key, Sketch()
                total.merge(Sketch.load(blob[i].as_py()))
        if now is not None:
            yield out()

    # the number is given: sketches are few bytes and much work, which would else be joined into few tasks
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select(*keys, "sketch").repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(add, schema)


def percentiles(merged: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """The wanted percentiles of each sketch, and the bound of their rank error."""
    keep = [c for c in merged.columns if c not in ("sketch", "n")]
    kind = "struct<" + ",".join(f"{n}:double" for n in wanted) + ",rank_error:double>"

    def invert(blobs: pd.Series) -> pd.DataFrame:
        made = [Sketch.load(bytes(b)) for b in blobs]
        return pd.DataFrame({n: [s.quantile(q) for s in made] for n, q in wanted.items()} | {"rank_error": [s.rank_error() for s in made]}, dtype=float)

    inverted = merged.filter("n > 0.5").withColumn("_q", F.pandas_udf(invert, kind)("sketch"))
    return inverted.select(*keep, F.round("n").cast("long").alias("n"), "_q.*")


FEW = 2_000_000  # repeated ids that are sent to every executor, 16 bytes each; more are joined by exchange


def once(rows: DataFrame, id_: str, keys: list[str], vectors: list[str]) -> DataFrame:
    """All rows with ``weight``: 1, and of an id that comes n times 1 / n each, so that it counts once.

    Two scans: one of the ids alone, which finds the repeated ones, and one of
    the rows. Copies under one id carry the same vectors; a null id is an id of
    its own.
    """
    rows = rows.select(id_, *keys, *vectors)
    again = written(rows.select(id_).groupBy(id_).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n > 1 and {id_} is not null"))
    if again.count() <= FEW:
        again = F.broadcast(again)
    return rows.join(again, id_, "left").select(*keys, *vectors, (F.lit(1.0) / F.coalesce("_n", F.lit(1))).alias("weight"))

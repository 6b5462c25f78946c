"""Exact quantiles of list columns by radix selection, in bounded memory.

A value is its order-preserving bits. A pass counts the next 16 bits of the
values that share the leading bits of a wanted rank, so float vectors take two
scans and double ones four; nothing is sorted, exploded or shuffled but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinelake.functions.vectors import matrix

DIGIT = 16
SALTS = 256


def codes_of(values: np.ndarray, wide: bool) -> np.ndarray:
    """Bits in the order of the values."""
    if wide:
        bits = values.astype(np.float64).view(np.uint64)
        return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    bits = values.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))


def values_of(codes: np.ndarray, wide: bool) -> np.ndarray:
    if wide:
        c = codes.astype(np.uint64)
        return np.where(c >> np.uint64(63), c & np.uint64((1 << 63) - 1), ~c).view(np.float64)
    c = codes.astype(np.uint32)
    return np.where(c >> np.uint32(31), c & np.uint32((1 << 31) - 1), ~c).view(np.float32).astype(float)


class Counts:
    """Numbers of the next digits of one group: keys are (dimension, place of the wanted prefix, digit)."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((key, n))
        if len(self.waiting) > 16:
            self.settle()

    def settle(self) -> Counts:
        keys = np.concatenate([self.key, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.n, *(n for _, n in self.waiting)])
        self.key, where = np.unique(keys, return_inverse=True)
        self.n, self.waiting = np.bincount(where, counts, len(self.key)).astype(np.int64), []
        return self


Wanted = dict[tuple, dict[int, np.ndarray]]  # group -> dimension -> rising prefixes


def _counted(rows: DataFrame, by: list[str], vector: str, wide: bool, shift: int, wanted: Wanted | None) -> DataFrame:
    """(by, key, n): per group the numbers of digits at ``shift`` below the wanted prefixes, all of them at first."""
    kinds = dict(rows.dtypes)
    names = [f"k{i}" for i in range(len(by))]
    schema = ", ".join([*(f"{a} {kinds[k]}" for a, k in zip(names, by)), "part int, key array<bigint>, n array<bigint>"])
    low = (1 << DIGIT) - 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counts] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            code = np.zeros(batch.num_rows, np.int64)
            for i in range(len(by)):
                d = batch.column(i).dictionary_encode()
                code = code * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(len(d.dictionary))).astype(np.int64)
            groups, first, member = np.unique(code, return_index=True, return_inverse=True)
            m = matrix(batch.column(len(by)))
            for g, f in enumerate(first):
                key = tuple(batch.column(i)[int(f)].as_py() for i in range(len(by)))
                part = m if len(groups) == 1 else m[member == g]
                tally = held.setdefault(key, Counts())
                for dim in range(m.shape[1]):
                    x = part[:, dim]
                    c = codes_of(x[~np.isnan(x)], wide)
                    kind = c.dtype.type
                    if wanted is None:
                        n = np.bincount((c >> kind(shift)).astype(np.int64), minlength=1)
                        digits = np.flatnonzero(n)
                        tally.add(digits + (dim << 40), n[digits])
                        continue
                    prefix = c >> kind(shift + DIGIT)
                    for place, p in enumerate(wanted.get(key, {}).get(dim, ())):
                        inside = c[prefix == kind(p)]
                        n = np.bincount(((inside >> kind(shift)) & kind(low)).astype(np.int64), minlength=1)
                        digits = np.flatnonzero(n)
                        tally.add(digits + (dim << 40) + (place << 20), n[digits])
        number = TaskContext.get().partitionId() % SALTS
        for key, tally in held.items():
            tally.settle()
            one = pa.array([0, len(tally.key)], pa.int32())
            yield pa.record_batch([*(pa.array([v], t) for v, t in zip(key, types)), pa.array([number], pa.int32()), pa.ListArray.from_arrays(one, pa.array(tally.key)), pa.ListArray.from_arrays(one, pa.array(tally.n))], [*names, "part", "key", "n"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Counts()
        for key, n in zip(pdf["key"], pdf["n"]):
            total.add(np.asarray(key), np.asarray(n))
        total.settle()
        return pdf.iloc[:1][[*names, "part"]].assign(key=[total.key], n=[total.n])[[*names, "part", "key", "n"]]

    partial = rows.select(*by, vector).mapInArrow(count, schema)
    if rows.rdd.getNumPartitions() > 2 * SALTS:
        partial = partial.groupBy(*names, "part").applyInPandas(merged, schema)
    return partial.groupBy(*names).applyInPandas(merged, schema)


def vector_quantiles(rows: DataFrame, by: list[str], vector: str, qs: dict[str, float]) -> DataFrame:
    """(by, dim, n, names): exact quantiles with linear interpolation of each dimension of a list column.

    Null and NaN cells and null lists are left out, short lists have no cell
    beyond their end. ``by`` names few groups (sources): a row per group,
    dimension and rank comes to the driver, as it does with any statistics.
    """
    spark = rows.sparkSession
    kinds = dict(rows.dtypes)
    wide = kinds[vector] == "array<double>"
    bits = 64 if wide else 32
    ranks: dict[str, Callable[[int], tuple[int, int, float]]] = {k: (lambda n, q=q: (int(np.floor(q * (n - 1))), int(np.ceil(q * (n - 1))), q * (n - 1) - np.floor(q * (n - 1)))) for k, q in qs.items()}
    sizes: dict[tuple, dict[int, int]] = {}
    state: dict[tuple, dict[int, dict[int, tuple[int, int]]]] = {}  # group, dimension, rank -> (prefix, values before it)
    wanted: Wanted | None = None
    for shift in range(bits - DIGIT, -1, -DIGIT):
        for r in _counted(rows, by, vector, wide, shift, wanted).toLocalIterator():
            group = tuple(r[f"k{i}"] for i in range(len(by)))
            key, n = np.array(r["key"], np.int64), np.array(r["n"], np.int64)
            dims = key >> 40
            for dim in np.unique(dims).tolist():
                mine = dims == dim
                digit, place, count = key[mine] & ((1 << 20) - 1), (key[mine] >> 20) & ((1 << 20) - 1), n[mine]
                if wanted is None:
                    total = int(count.sum())
                    sizes.setdefault(group, {})[dim] = total
                    state.setdefault(group, {})[dim] = {k: (0, 0) for f in ranks.values() for k in f(total)[:2]}
                told = state[group][dim]
                for rank, (prefix, before) in told.items():
                    at = 0 if wanted is None else int(np.searchsorted(wanted[group][dim], prefix))
                    inside = place == at
                    upto = np.cumsum(count[inside])
                    i = int(np.searchsorted(upto, rank - before, "right"))
                    told[rank] = ((prefix << DIGIT) | int(digit[inside][i]), before + (int(upto[i - 1]) if i else 0))
        wanted = {g: {d: np.unique(np.array([p for p, _ in t.values()], np.uint64 if wide else np.uint32)) for d, t in dims.items()} for g, dims in state.items()}
    out = []
    for group, dims in state.items():
        for dim, told in dims.items():
            n = sizes[group][dim]
            value = {rank: float(values_of(np.array([p], np.uint64), wide)[0]) for rank, (p, _) in told.items()}
            row = []
            for f in ranks.values():
                lo, hi, share = f(n)
                row.append(value[lo] + (value[hi] - value[lo]) * float(share) if share and value[hi] > value[lo] else value[lo])
            out.append((*group, dim, n, *row))
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "dim bigint, n bigint", *(f"`{k}` double" for k in qs)])
    return spark.createDataFrame(out, schema)

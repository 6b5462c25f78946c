"""Implausible readings in sensor vectors.

Each series (one dimension of one episode) has an undecimated decomposition by
lifting: at level 1 to 3 the detail of a window of so many readings is the least
that one of them departs from its prediction by the readings on both sides, with
two predictors: the line between the two nearest, and, for smooth motion, both
sides' lines carried on, from four. The frame-to-frame differences are level 0.
Per source, vector, dimension, level and predictor a log-scaled histogram over
all data gives the scale of ordinary details: their median and 90th percentile,
made deviations of a normal distribution, of which the larger counts; neither
moves by cases that are fewer than a tenth. Details far beyond their scale are
departures, runs of zero detail are readings that stand still, and bounds find
what cannot be.

Defined results: null, NaN and cut-off readings are never reported and are
skipped by the series; a frame repeated under its id counts once; a frame
without id is ignored; one without repo, episode or frame index is only held
against the bounds; sources without bounds have no case (a); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.vectors import matrix
from kinelake.session import cut

VECTORS = ("state", "action")
ZERO_BIN = -32768
LEVELS = (1, 2, 3)  # readings in a window
KIND = 1 << 12  # times a kind of histogram, added to a dimension's number
LINE, CARRIED, RUNS = 0, 3, 7  # kinds: 0 differences, 1 to 3 and 4 to 6 the levels by either predictor, lengths of runs of zero detail


@dataclass(frozen=True)
class SpikeRule:
    """``far``: a detail beyond so many deviations of its level's ordinary ones is a
    departure; ``carried``: by the four-point predictor, where both sides'
    predictions differ by no more than ``agree`` of the departure and no side's
    slope is beyond ``steep`` deviations of the differences. ``still``: a detail within that share of the median one
    is a trace. ``chance``: a run is stuck if ordinary still frames would make
    one as long less often than this; ``min_run`` frames at least. ``moves``: a
    dimension moves if no larger share of its details is still. ``coarse``: one
    of which more stand still has ordinary runs, and a run is stuck from the
    length on at which the share of ordinary ones is ``ordinary``. ``joint``: so
    many dimensions that stand still together need only ``min_run`` frames.
    ``block`` and ``halo``: long episodes are cut into blocks of frames that see
    so many frames of their neighbours.
    """

    far: float = 17.0
    carried: float = 17.0
    agree: float = 0.6
    steep: float = 5.0
    still: float = 0.03
    chance: float = 1e-4
    min_run: int = 8
    moves: float = 0.75
    coarse: float = 0.1
    ordinary: float = 0.2
    joint: int = 3
    bins: int = 8
    least: int = 20
    block: int = 4096
    halo: int = 128


def blocks(frames: DataFrame, rule: SpikeRule) -> DataFrame:
    """Frames by block of their episode, in order; halo rows are not ``core``."""
    placed = F.col("frame_index").isNotNull() & F.col("repo_index").isNotNull() & F.col("episode_index").isNotNull()
    at = F.floor(F.when(placed, F.col("frame_index")) / rule.block)
    inside = F.pmod(F.col("frame_index"), F.lit(rule.block))
    near = F.array_compact(
        F.array(
            at,
            F.when((inside < rule.halo) & (at > 0), at - 1),
            F.when(inside >= rule.block - rule.halo, at + 1),
        )
    )
    # frames without a place are spread by id and looked at one by one
    alone = F.lit(-1).cast("long") - F.pmod(F.xxhash64("frame_id"), F.lit(1 << 20))
    keyed = (
        frames.filter("frame_id is not null")
        .select("frame_id", "dataset_name", "repo_index", "episode_index", "frame_index", *VECTORS)
        .withColumn("block", F.explode(F.when(placed, near).otherwise(F.array(alone))))
        .withColumn("core", F.col("block") == F.coalesce(at, alone))
    )
    keys = ["repo_index", "episode_index", "block"]
    return keyed.repartition(*keys).sortWithinPartitions("dataset_name", *keys, "frame_index", "frame_id")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of sorted batches in which no group of ``keys`` is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            codes = group_codes(batch.column(key))
            changed[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(changed)
        if not len(starts):
            same = held and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if held and not same:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
            continue
        last = int(starts[-1])
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_codes(column) -> np.ndarray:
    """Numbers that are equal where the values are; null is a value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    encoded = column.dictionary_encode()
    return np.asarray(encoded.indices.fill_null(-1)).astype(np.int64)


class Series:
    """All readings of one source and vector in one table, as one flat series."""

    def __init__(self, values: np.ndarray, group: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None):
        rows, dims = values.shape
        flat = values.T.ravel().astype(np.float32).astype(np.float64)
        self.row, self.dim = np.tile(np.arange(rows), dims), np.repeat(np.arange(dims), rows)
        self.beyond = np.zeros(len(flat), bool)
        if bounds is not None:
            lo, hi = (np.float32(b[:dims]).astype(np.float64) for b in bounds)
            with np.errstate(invalid="ignore"):
                self.beyond = (flat < np.repeat(lo, rows)) | (flat > np.repeat(hi, rows))
        ok = np.isfinite(flat) & ~self.beyond
        self.v, self.of, self.at = flat[ok], self.dim[ok], self.row[ok]
        series = np.tile(group, dims)[ok] + self.of * (int(group.max(initial=0)) + 1)
        self.same = series[1:] == series[:-1]
        self.detail = np.abs(np.diff(self.v))
        self.breaks = np.concatenate([[0], np.cumsum(~self.same)])

    def windows(self, width: int) -> np.ndarray:
        """Where windows of ``width`` readings begin that have a reading of their series on both sides."""
        a = np.arange(1, max(1, len(self.v) - width))
        return a[self.breaks[a - 1] == self.breaks[a + width]]

    def carried(self, a: np.ndarray, width: int, steepest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least departure in each window from both sides' lines carried on, and how far these differ.

        A side without a second reading, or with one further off than
        ``steepest``, takes the other side's slope.
        """
        n = len(self.v)
        before, after = self.v[a - 1], self.v[a + width]
        far, next_ = np.maximum(a - 2, 0), np.minimum(a + width + 1, n - 1)
        left = np.where((a >= 2) & (self.breaks[far] == self.breaks[a]), before - self.v[far], np.nan)
        right = np.where((a + width + 1 < n) & (self.breaks[next_] == self.breaks[a]), self.v[next_] - after, np.nan)
        middle = (after - before) / (width + 1)
        if steepest is not None:
            limit = steepest[self.of[a]]
            left[np.abs(left) > limit], right[np.abs(right) > limit] = np.nan, np.nan
            middle = np.clip(middle, -limit, limit)
        left = np.where(np.isnan(left), np.where(np.isnan(right), middle, right), left)
        right = np.where(np.isnan(right), left, right)
        least, apart = np.full(len(a), np.inf), np.zeros(len(a))
        for j in range(width):
            one, two = before + (j + 1) * left, after - (width - j) * right
            least = np.minimum(least, np.abs(self.v[a + j] - (one * (width - j) + two * (j + 1)) / (width + 1)))
            apart = np.maximum(apart, np.abs(one - two))
        return least, apart

    def line(self, a: np.ndarray, width: int) -> np.ndarray:
        """Least departure in each window from the line between the readings on both sides."""
        before, after = self.v[a - 1], self.v[a + width]
        least = np.full(len(a), np.inf)
        for j in range(width):
            least = np.minimum(least, np.abs(self.v[a + j] - (before + (after - before) * (j + 1) / (width + 1))))
        return least

    def histogram(self, core: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (see :func:`detail_histogram`) and numbers of the details of core rows, and of the lengths of zero runs."""
        use = self.same & core[self.at[1:]]
        details, of = [self.detail[use]], [self.of[1:][use]]
        for width in LEVELS:
            a = self.windows(width)
            a = a[core[self.at[a]]]
            details += [self.line(a, width), self.carried(a, width)[0]]
            of += [self.of[a] + (LINE + width) * KIND, self.of[a] + (CARRIED + width) * KIND]
        d, of = np.concatenate(details), np.concatenate(of)
        code = np.full(len(d), ZERO_BIN, np.int64)
        moved = d > 1e-9
        code[moved] = np.floor(np.log2(d[moved]) * bins).astype(np.int64)
        edges = np.diff(np.concatenate([[0], (self.same & (self.detail <= 1e-9)).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        mine = core[self.at[begin]] if len(begin) else np.zeros(0, bool)
        of = np.concatenate([of, self.of[begin[mine]] + RUNS * KIND])
        code = np.concatenate([code, np.minimum(end - begin + 1, 100)[mine]])
        return np.unique(of * 65536 + code + 32768, return_counts=True)

    def departures(self, limit: np.ndarray, motion: np.ndarray, steepest: np.ndarray, agree: float) -> np.ndarray:
        """Readings of departures of one to three frames: details beyond ``limit`` (levels x dimensions) from the line, or ``motion`` from carried lines."""
        found = np.zeros(len(self.v), bool)
        for level, width in enumerate(LEVELS):
            a = self.windows(width)
            if not len(a):
                continue
            least, apart = self.carried(a, width, steepest)
            moved = (least > motion[level][self.of[a]]) & (apart <= agree * least)
            least = self.line(a, width)
            a = a[moved | (least > limit[level][self.of[a]]) & (least >= np.abs(self.v[a + width] - self.v[a - 1]))]
            for j in range(width):
                found[a + j] = True
        return found

    def stuck(self, trace: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Readings, but the first, of runs of ``need`` readings within ``trace`` of each other."""
        still = self.same & (self.detail <= trace[self.of[1:]])
        return np.concatenate([[False], _long(still, need[self.of[1:]] - 1)]) if len(self.v) else still

    def pairs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.at[mask], self.of[mask]


def _long(still: np.ndarray, need: np.ndarray) -> np.ndarray:
    """True in the runs of ``still`` that are as long as ``need`` says at their start."""
    edges = np.diff(np.concatenate([[0], still.astype(np.int8), [0]]))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = (end - start) >= need[start] if len(start) else np.zeros(0, bool)
    mark = np.zeros(len(still) + 1, np.int64)
    np.add.at(mark, start[keep], 1)
    np.add.at(mark, end[keep], -1)
    return np.cumsum(mark[:-1]) > 0


def _joint(values: np.ndarray, group: np.ndarray, trace: np.ndarray, rule: SpikeRule) -> np.ndarray:
    """Rows in runs where all moving dimensions stand still at once."""
    still = np.zeros(len(values), bool)
    moving = np.isfinite(trace) & (trace > 0)
    if len(values) > 1 and moving.sum() >= rule.joint:
        d = np.abs(np.diff(values[:, moving], axis=0))
        known = np.isfinite(d)
        quiet = (d <= trace[moving]) | ~known
        still[1:] = quiet.all(1) & (known.sum(1) >= rule.joint) & (group[1:] == group[:-1])
    return _long(still, np.full(len(still), rule.min_run - 1))


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.Table, np.ndarray]]:
    """Whole episodes' blocks by source, each frame once, with their group numbers."""
    keys = ["dataset_name", "repo_index", "episode_index", "block"]
    for t in whole_groups(batches, keys):
        change = np.zeros(t.num_rows, bool)
        for key in keys:
            codes = group_codes(t.column(key))
            change[1:] |= codes[1:] != codes[:-1]
        group = np.cumsum(change)
        frame = np.asarray(t.column("frame_id").combine_chunks())
        loose = np.asarray(t.column("block").combine_chunks()) < 0
        once = np.ones(len(frame), bool)
        once[1:] = (frame[1:] != frame[:-1]) | change[1:]
        group = np.where(loose, group.max(initial=0) + 1 + np.arange(len(group)), group)
        source = group_codes(t.column("dataset_name"))
        for code in np.unique(source):
            pick = np.flatnonzero((source == code) & once)
            part = t.take(pa.array(pick))
            yield part.column("dataset_name")[0].as_py(), part, group[pick]


Bounds = dict[tuple[str | None, str], tuple[np.ndarray, np.ndarray]]


HISTOGRAM = "dataset_name string, vector string, part int, code array<bigint>, n array<bigint>"


def detail_histogram(placed: DataFrame, bounds: Bounds, rule: SpikeRule, salts: int = 256) -> DataFrame:
    """(dataset_name, vector, code, n): numbers of details by dimension with its kind and log bin, a row per source and vector.

    ``placed``: frames as :func:`blocks` puts them. ``code`` is ``(kind * KIND + dim) * 65536 + bin + 32768``. A task adds up its
    own rows; where tasks are many, their histograms are added by salt first.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        for name, t, group in _tables(batches):
            core = np.asarray(t.column("core").combine_chunks().cast(pa.int8())).astype(bool)
            for vector in VECTORS:
                limits = bounds.get((name, vector))
                values = matrix(t.column(vector), None if limits is None else len(limits[0]))
                parts = held.setdefault((name, vector), [])
                parts.append(Series(values, group, limits).histogram(core, rule.bins))
                if len(parts) > 16:
                    parts[:] = [_added(parts)]
        part = TaskContext.get().partitionId() % salts
        for (name, vector), parts in held.items():
            code, n = _added(parts)
            one = pa.array([0, len(code)], pa.int32())
            yield pa.record_batch([pa.array([name], pa.string()), pa.array([vector]), pa.array([part], pa.int32()), pa.ListArray.from_arrays(one, pa.array(code)), pa.ListArray.from_arrays(one, pa.array(n))], [c.split()[0] for c in HISTOGRAM.split(", ")])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        code, n = _added(list(zip(pdf["code"], pdf["n"])))
        return pd.DataFrame({"dataset_name": pdf["dataset_name"].iloc[:1], "vector": pdf["vector"].iloc[:1], "part": pdf["part"].iloc[:1], "code": [code], "n": [n]})

    partial = placed.mapInArrow(count, HISTOGRAM)
    if int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 2 * salts:
        partial = partial.groupBy("dataset_name", "vector", "part").applyInPandas(merged, HISTOGRAM)
    return partial.groupBy("dataset_name", "vector").applyInPandas(merged, HISTOGRAM).drop("part")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Histograms given as codes and numbers, as one."""
    code, where = np.unique(np.concatenate([p[0] for p in parts]).astype(np.int64), return_inverse=True)
    return code, np.bincount(where, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)


def deviation(rows: list[tuple[int, int]], bins: int, least: int) -> float:
    """The deviation of ordinary non-zero details, by (bin, number): from their median or their 90th percentile, whichever tells more."""
    rows = sorted(r for r in rows if r[0] != ZERO_BIN)
    upto = np.cumsum([n for _, n in rows])
    if not len(upto) or upto[-1] < least:
        return np.inf
    at = lambda q: 2 ** ((rows[int(np.searchsorted(upto, q * upto[-1]))][0] + 0.5) / bins)
    return max(at(0.5) / 0.6745, at(0.9) / 1.6449)


def scales(histogram, rule: SpikeRule) -> dict[tuple[str | None, str], dict[str, np.ndarray]]:
    """Per source and vector, by dimension: limits of departures, ``trace`` and ``need`` of stuck runs.

    ``histogram``: (source, vector, dimension with its kind, bin, number) rows, a few hundred bins per dimension and kind.
    """
    grouped: dict[tuple, dict[int, list]] = {}
    for name, vector, dim, bin_, n in histogram:
        grouped.setdefault((name, vector), {}).setdefault(dim, []).append((bin_, n))
    out = {}
    for key, dims in grouped.items():
        width = max(d % KIND for d in dims) + 1
        limit, motion = np.full((len(LEVELS), width), np.inf), np.full((len(LEVELS), width), np.inf)
        trace, need, steepest = np.full(width, -1.0), np.full(width, 2**40), np.full(width, np.inf)
        for dim in range(width):
            rows = sorted(dims.get(dim, ()))
            n = np.array([r[1] for r in rows if r[0] != ZERO_BIN], float)
            at = np.array([r[0] for r in rows if r[0] != ZERO_BIN], float)
            total, moved = sum(r[1] for r in rows), n.sum()
            if moved < rule.least:
                continue
            for level, readings in enumerate(LEVELS):
                limit[level, dim] = rule.far * deviation(dims.get(dim + (LINE + readings) * KIND, []), rule.bins, rule.least)
                motion[level, dim] = rule.carried * deviation(dims.get(dim + (CARRIED + readings) * KIND, []), rule.bins, rule.least)
            steepest[dim] = rule.steep * deviation(rows, rule.bins, rule.least)
            tol = rule.still * 2 ** ((at[np.searchsorted(np.cumsum(n) / moved, 0.5)] + 0.5) / rule.bins)
            p = (total - moved + n[2 ** ((at + 1) / rule.bins) <= tol].sum()) / total
            if p <= rule.moves:
                trace[dim] = tol
                need[dim] = rule.min_run if p <= 0 else max(rule.min_run, 1 + int(np.ceil(np.log(rule.chance) / np.log(p))))
                if p > rule.coarse:
                    need[dim] = max(need[dim], natural_run(dict(dims.get(dim + RUNS * KIND, ())), rule.ordinary))
        out[key] = {"limit": limit, "motion": motion, "steepest": steepest, "trace": trace, "need": need}
    return out


def source_scales(histogram: DataFrame, rule: SpikeRule) -> dict[tuple[str | None, str], dict[str, np.ndarray]]:
    """:func:`scales` of all sources, made where their histograms are: about ten numbers per dimension come to the driver."""
    names = ["limit", "motion", "trace", "need", "steepest"]

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                code = np.asarray(r.code)
                rows = zip((code // 65536).tolist(), (code % 65536 - 32768).tolist(), np.asarray(r.n).tolist())
                found = scales([(r.dataset_name, r.vector, *x) for x in rows], rule).get((r.dataset_name, r.vector))
                if found is None:  # no detail at all
                    continue
                yield pd.DataFrame({"dataset_name": [r.dataset_name], "vector": [r.vector], **{k: [found[k].astype(float).ravel()] for k in names}})

    schema = "dataset_name string, vector string, " + ", ".join(f"{k} array<double>" for k in names)
    out = {}
    for r in histogram.mapInPandas(one, schema).collect():
        told = {k: np.array(r[k], float) for k in names}
        width = len(told["trace"])
        out[r["dataset_name"], r["vector"]] = told | {k: told[k].reshape(-1, width) for k in ("limit", "motion")} | {"need": told["need"].astype(np.int64)}
    return out


def natural_run(lengths: dict[int, int], share: float) -> int:
    """The length from which runs of a coarse dimension are stuck rather than ordinary.

    Ordinary runs fall off geometrically beyond about a dozen readings; the
    length is the first from which no more than ``share`` of the runs are
    expected to be ordinary. With too few runs to tell it is 24; without any
    such length no run counts.
    """
    n = np.zeros(102)
    for length, k in lengths.items():
        n[length] += k
    near, far = n[8:13].sum(), n[13:18].sum()
    if near < 20:
        return 24
    q = min(max(far / near, 0.02), 0.9) ** 0.2
    for length in range(18, 101):
        if n[length:].sum() and max(far, 1) / 5 * q ** (length - 15) / (1 - q) <= share * n[length:].sum():
            return length
    return 2**40


def _widened(x: np.ndarray, width: int, fill: float) -> np.ndarray:
    """The last axis at ``width``, cut or filled."""
    more = np.full((*x.shape[:-1], max(0, width - x.shape[-1])), fill, x.dtype)
    return np.concatenate([x, more], axis=-1)[..., :width]


def find_spikes(frames: DataFrame, bounds: Bounds, held: dict[tuple[str | None, str], set[int]] | None = None, rule: SpikeRule = SpikeRule()) -> DataFrame:
    """(frame_id, vector, dim) of every implausible reading, judged by its source.

    ``bounds``: arrays of lowest and highest possible values by (source,
    vector); ``held``: dimensions that open and close by design, which have only
    bounds. Both come from small dictionary tables, as do the scales: a few
    numbers per dimension of each source.
    """
    held = held or {}
    placed = cut(blocks(frames, rule))  # exchanged once, read twice: for the scales and to be judged
    by_source = source_scales(detail_histogram(placed, bounds, rule), rule)
    for key, dims in held.items():
        for dim in dims:
            if key in by_source and dim < len(by_source[key]["trace"]):
                by_source[key]["limit"][:, dim], by_source[key]["motion"][:, dim], by_source[key]["trace"][dim] = np.inf, np.inf, -1.0

    def flag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, t, group in _tables(batches):
            core = np.asarray(t.column("core").combine_chunks().cast(pa.int8())).astype(bool)
            frame = np.asarray(t.column("frame_id").combine_chunks())
            for vector in VECTORS:
                limits = bounds.get((name, vector))
                values = matrix(t.column(vector), None if limits is None else len(limits[0]))
                s = Series(values, group, limits)
                hit = np.zeros(values.shape, bool)
                hit[s.row[s.beyond], s.dim[s.beyond]] = True
                scale = by_source.get((name, vector))
                if scale is not None and len(s.v):
                    width = values.shape[1]
                    grow = {k: _widened(x, width, {"trace": -1, "need": 2**40}.get(k, np.inf)) for k, x in scale.items()}
                    for mask in (s.departures(grow["limit"], grow["motion"], grow["steepest"], rule.agree), s.stuck(grow["trace"], grow["need"])):
                        hit[s.pairs(mask)] = True
                    if (grow["need"][grow["trace"] > 0] > rule.min_run).any():
                        inside = values.copy()
                        inside[s.row[s.beyond], s.dim[s.beyond]] = np.nan
                        joint = _joint(inside, group, grow["trace"], rule)
                        hit |= joint[:, None] & (grow["trace"] > 0) & np.isfinite(inside)
                at, dim = np.nonzero(hit & core[:, None])
                if len(at):
                    yield pa.record_batch([pa.array(frame[at], pa.int64()), pa.array([vector] * len(at)), pa.array(dim.astype(np.int32))], ["frame_id", "vector", "dim"])

    return placed.mapInArrow(flag, "frame_id long, vector string, dim int")

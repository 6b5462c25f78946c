"""Windows over the steps of an episode: chunks, history, segments, grids.

Frame tables have one row per step with the columns of ``EPISODE`` keys, a
``frame`` number from 0 and values. Gathers come in two forms, chosen by the
episode's size: one row per episode with arrays (one shuffle, no join), or rows
joined on the frame they want (episodes of any length, spread by frame).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.joins import asof
from kinelake.session import cut

MAX_HISTORY = 64


def n_steps(length_s: float, freq_hz: float) -> int:
    """Steps of a horizon; Python's round is half-even."""
    return max(1, round(length_s * freq_hz)) if length_s > 0 and freq_hz > 0 else 1


def native_stride(native_fps: float, freq_hz: float) -> int:
    """Frames between samples; without a frequency every frame is one. A rate that is not positive raises."""
    if not native_fps > 0:
        raise ValueError(f"a dump at {native_fps} frames a second")
    return max(1, round(native_fps / freq_hz)) if freq_hz > 0 else 1


def delta_indices(length_s: float, freq_hz: float, native_fps: float, past: bool = False) -> list[int]:
    n, s = n_steps(length_s, freq_hz), native_stride(native_fps, freq_hz)
    return [(k - (n - 1 if past else 0)) * s for k in range(n)]


def locked_frequency(space, native_fps: float, freq: float | None) -> float:
    """Stored deltas can't be subsampled: their frequency is the native one, another raises."""
    if any(s.stored for s in space):
        if freq is not None and native_stride(native_fps, freq) != 1:
            raise ValueError(f"stored deltas at {native_fps} Hz can't be read at {freq} Hz")
        return native_fps
    return freq or native_fps


def numbered(events: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Adds ``frame`` from 0 in the order given and ``n``, the episode's length."""
    by = W.partitionBy(*keys)
    return events.withColumn("frame", F.row_number().over(by.orderBy(*order)).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(by))


def gather_join(frames: DataFrame, keys: list[str], deltas: list[int], values: list[str], lower: Column | None = None, upper: Column | None = None) -> DataFrame:
    """Rows (keys, frame, k, src, values) of the steps ``frame + delta``, clamped to ``lower .. upper - 1``.

    By default to the episode. Wanted steps are joined on (keys, frame), so a
    long episode is spread over all tasks.
    """
    lo = F.lit(0).cast("long") if lower is None else lower
    hi = (F.col("n") if upper is None else upper) - 1
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(d).cast("long").alias("d")) for i, d in enumerate(deltas)])
    want = frames.select(*keys, "frame", lo.alias("_lo"), hi.alias("_hi"), F.explode(steps).alias("_s"))
    want = want.select(*keys, "frame", F.col("_s.k").alias("k"), F.greatest(F.least(F.col("frame") + F.col("_s.d"), "_hi"), "_lo").alias("src"))
    return want.join(frames.select(*keys, F.col("frame").alias("src"), *values), [*keys, "src"])


def gather_array(frames: DataFrame, keys: list[str], deltas: list[int], values: list[str]) -> DataFrame:
    """The same rows from one array per episode: for episodes that fit in a row."""
    packed = frames.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame", *values))).alias("_a"))
    n = F.size("_a")
    steps = F.array(*[F.lit(d) for d in deltas])
    picked = F.transform(steps, lambda d, k: F.struct(k.cast("long").alias("k"), F.greatest(F.least(F.col("frame") + d, n - 1), F.lit(0)).cast("long").alias("src")))
    each = packed.select(*keys, "_a", F.explode(F.transform("_a", lambda x: x["frame"])).alias("frame"))
    each = each.select(*keys, "frame", "_a", F.explode(picked).alias("_p"))
    return each.select(*keys, F.col("_p.src").alias("src"), "frame", F.col("_p.k").alias("k"), *[F.element_at("_a", (F.col("_p.src") + 1).cast("int"))[v].alias(v) for v in values])


def gather(frames: DataFrame, keys: list[str], deltas: list[int], values: list[str], longest: int | None = None) -> DataFrame:
    """Clamped gather; as arrays where ``longest`` says that no episode has more than 20,000 steps."""
    if longest is not None and longest <= 20_000:
        return gather_array(frames, keys, deltas, values)
    return gather_join(frames, keys, deltas, values)


def history_offsets(length: float, freq: float) -> list[float]:
    """Seconds before now, oldest first."""
    if not (math.isfinite(length) and length >= 0 and math.isfinite(freq) and freq > 0):
        raise ValueError(f"history of {length} s at {freq} Hz")
    if length * freq > MAX_HISTORY:
        raise ValueError(f"history of more than {MAX_HISTORY} observations")
    n = n_steps(length, freq)
    return [(k - (n - 1)) / freq for k in range(n)]


def timed_history(frames: DataFrame, keys: list[str], fps: float | Column, length: float, freq: float, values: list[str], lower: Column | None = None) -> DataFrame:
    """Causal history in seconds: (keys, frame, k, src, valid, offset, values).

    The step at or before each target time, never one after; not valid where it
    lies before ``lower`` or more than a sampling period before its target.
    ``fps`` may be a column of the episode.
    """
    lo = F.lit(0).cast("long") if lower is None else lower
    offsets = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(o).alias("o")) for i, o in enumerate(history_offsets(length, freq))])
    rate = (fps if isinstance(fps, Column) else F.lit(float(fps))).cast("double")
    want = frames.select(*keys, "frame", lo.alias("_lo"), rate.alias("_fps"), F.explode(offsets).alias("_o"))
    target = F.col("frame") + F.col("_o.o") * F.col("_fps")
    at = F.floor(target + 1e-9)
    want = want.select(
        *keys, "frame", F.col("_o.k").alias("k"), F.greatest(at, "_lo").alias("src"),
        ((at >= F.col("_lo")) & (target - at <= F.col("_fps") / freq + 1e-9)).alias("valid"), "_fps",
    ).withColumn("offset", (F.col("src") - F.col("frame")) / F.col("_fps")).drop("_fps")
    return want.join(frames.select(*keys, F.col("frame").alias("src"), *values), [*keys, "src"])


def timestamp_history(obs: DataFrame, keys: list[str], ts: str, length: float, freq: float, values: list[str], tol: float = 1e-9, block: float | None = None) -> DataFrame:
    """As-of history by time: (keys, now, k, valid, offset, values of the latest observation by each target).

    ``ts`` in seconds, distinct within keys. Targets and observations are
    united and swept in order of time, so no pairs are made; in blocks of
    ``block`` seconds (by default 4,096 sampling periods), so that no stream is
    one task. A target before the first observation takes that one and is not valid.
    """
    offsets = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(o).alias("o")) for i, o in enumerate(history_offsets(length, freq))])
    target = obs.select(*keys, F.col(ts).alias("now"), F.explode(offsets).alias("_o"))
    target = target.select(*keys, "now", F.col("_o.k").alias("k"), F.col("_o.o").alias("_o"), (F.col("now") + F.col("_o.o") + tol).alias("_target"))
    seen = obs.select(*keys, F.col(ts).alias("_t"), *values)
    got = asof(target, seen, keys, "_target", "_t", ["_t", *values], block=4096 / freq if block is None else block)
    valid = (F.col("_t") <= F.col("_target")) & (F.col("_o") - (F.col("_t") - F.col("now")) <= F.lit(1 / freq + tol))
    return got.select(*keys, "now", "k", valid.alias("valid"), (F.col("_t") - F.col("now")).alias("offset"), *values)


def running(rows: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows of the same keys that come before in ``order``.

    Prefix sums in two levels: over ranges of (keys, order), a row each, and
    inside; neither a large group nor the whole table is one task. Ties of the
    order come in any order; null sizes count as 0.
    """
    spark = rows.sparkSession
    parts = spark.sparkContext.defaultParallelism * 4
    # ranges are sampled; the parts must be those of one run
    ranged = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(n).alias("_s"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumn("_inner", F.coalesce(F.sum(n).over(inner), F.lit(0))).join(base, same)
    return out.withColumn("before", (F.col("_base") + F.col("_inner")).cast("long")).drop("_part", "_p", "_base", "_inner", *[f"_k{i}" for i in range(len(keys))])


def sample_index(episodes: DataFrame, order: list[str], size: str = "n") -> DataFrame:
    """Adds ``start`` and ``stop`` of each episode in the index space of all samples."""
    return running(episodes, [], order, size).withColumnRenamed("before", "start").withColumn("stop", (F.col("start") + F.coalesce(F.col(size), F.lit(0))).cast("long"))


def derived_actions(frames: DataFrame, keys: list[str], value: str, stride: int, mode: str = "abs", name: str = "action") -> DataFrame:
    """Actions from states: the state ``stride`` steps on, the last one at the end; less the own one in rel and delta."""
    w = W.partitionBy(*keys).orderBy("frame")
    last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ahead = F.coalesce(F.lead(value, stride).over(w), last)
    return frames.withColumn(name, ahead if mode == "abs" else ahead - F.col(value))


def next_state_actions(frames: DataFrame, keys: list[str], value: str, name: str = "action") -> DataFrame:
    """Pairs of a state and the next one; the last step has none and goes."""
    return frames.withColumn(name, F.lead(value).over(W.partitionBy(*keys).orderBy("frame"))).filter(F.col(name).isNotNull())


def run_segments(frames: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, start, stop, value) of the runs of equal values; null is a value."""
    w = W.partitionBy(*keys).orderBy("frame")
    new = F.when(F.lag("frame").over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)
    run = frames.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*keys, "_run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.first(value).alias(value)).drop("_run")


def segment_faults(segments: DataFrame, keys: list[str], n: str = "n", text: str = "text") -> DataFrame:
    """Segments that are empty, overlap the one before, leave the episode or have no text."""
    before = F.lag("stop").over(W.partitionBy(*keys).orderBy("start", "stop"))
    bad = (F.col("start") >= F.col("stop")) | (F.col("start") < 0) | (F.col("stop") > F.col(n)) | (F.coalesce(F.trim(text), F.lit("")) == "") | (F.coalesce(before, F.lit(0)) > F.col("start"))
    return segments.withColumn("_bad", bad).filter("_bad").drop("_bad")


def segment_samples(segments: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """(keys, sample, frame, lower, upper, carry): steps inside segments, gaps left out, numbered per episode."""
    before = F.sum(F.col("stop") - F.col("start")).over(W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    each = segments.withColumn("_base", F.coalesce(before, F.lit(0))).filter("stop > start")
    each = each.select(*keys, F.col("start").alias("lower"), F.col("stop").alias("upper"), "_base", *carry, F.explode(F.sequence("start", F.col("stop") - 1)).alias("frame"))
    return each.select(*keys, (F.col("_base") + F.col("frame") - F.col("lower")).cast("long").alias("sample"), "frame", "lower", "upper", *carry)


def merge_spans(parts: DataFrame, keys: list[str], order: str, text: str, size: str, fps: float) -> DataFrame:
    """(keys, text, start, end) in seconds of annotation spans; blanks drop out, equal neighbours become one."""
    w = W.partitionBy(*keys).orderBy(order)
    at = parts.withColumn("_stop", F.sum(size).over(w)).withColumn("_start", F.col("_stop") - F.col(size))
    kept = at.filter(F.trim(text) != "")
    new = F.when(F.lag("_stop").over(w).eqNullSafe(F.col("_start")) & F.lag(text).over(w).eqNullSafe(F.col(text)), 0).otherwise(1)
    run = kept.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return run.groupBy(*keys, "_run").agg(F.first(text).alias("text"), (F.min("_start") / F.lit(float(fps))).alias("start"), (F.max("_stop") / F.lit(float(fps))).alias("end")).drop("_run")


def grid(spans: DataFrame, tick: int, lo: str = "t0", hi: str = "t1", name: str = "tick") -> DataFrame:
    """A row per tick from ``lo`` to ``hi``, ends included; empty spans have none."""
    return spans.filter(F.col(lo) <= F.col(hi)).withColumn(name, F.explode(F.sequence(F.col(lo), F.col(hi), F.lit(tick).cast("long"))))

"""Joins by time, by interval and by lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(ticks: DataFrame, values: DataFrame, keys: list[str], tick: str, ts: str, value: list[str], strict: bool = False, clip: bool = True, block: float | None = None) -> DataFrame:
    """Each tick with the last values at or before it (before it, if ``strict``).

    Both sides are united and swept in order of time: one shuffle, no pairs. A
    tick before the first value takes the first one if ``clip``, else nulls. Of
    values at one time the last in order of the value columns counts. With
    ``block``, a length of time, each key is swept block by block, and a block
    takes over the last values before it from a table of one row per block: no
    key is one task.
    """
    seen = F.struct(F.col(ts).alias("_ts"), *value)
    kind = values.select(seen.alias("s")).schema["s"].dataType
    carried = [c for c in ticks.columns if c not in keys]
    left = ticks.select(*keys, F.struct(*carried).alias("_tick"), F.col(tick).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kind).alias("_seen"))
    right = values.select(*keys, F.lit(None).cast(left.schema["_tick"].dataType).alias("_tick"), F.col(ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"), seen.alias("_seen"))
    part = F.lit(0).cast("long") if block is None else F.floor(F.col("_at") / F.lit(block))
    rows = left.unionByName(right).withColumn("_part", part)
    order = W.partitionBy(*keys, "_part").orderBy("_at", "_side", "_seen")
    swept = rows.withColumn("_last", F.last("_seen", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    if clip or block is not None:
        ends = rows.groupBy(*keys, "_part").agg(F.max("_seen").alias("_z"), F.min("_seen").alias("_a"))
        blocks = W.partitionBy(*keys).orderBy("_part")
        ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.last("_z", True).over(blocks.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"), F.min("_a").over(W.partitionBy(*keys)).alias("_first"))
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        swept = swept.filter("_tick is not null").join(ends, same, "left").withColumn("_last", F.coalesce("_last", "_carry", *(["_first"] if clip else [])))
    return swept.filter("_tick is not null").select(*keys, *[F.col(f"_tick.{c}").alias(c) for c in carried], *[F.col(f"_last.{v}").alias(v) for v in value])


def overlap(events: DataFrame, keys: list[str], topic: str, ts: str) -> DataFrame:
    """(keys, t0, t1): from the latest first to the earliest last time of the topics."""
    by = events.groupBy(*keys, topic).agg(F.min(ts).alias("a"), F.max(ts).alias("z"))
    return by.groupBy(*keys).agg(F.max("a").alias("t0"), F.min("z").alias("t1"))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str = "start", stop: str = "stop", width: int = 1024) -> DataFrame:
    """Points with the spans ``start <= at < stop`` of their keys.

    Joined on keys and bucket: spans are listed in every bucket of ``width``
    they touch, so an equi-join does the work and a long episode is spread.
    """
    bucket = F.floor(F.col(at) / width)
    listed = spans.filter(F.col(start) < F.col(stop)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))
    return points.withColumn("_b", bucket).join(listed, [*keys, "_b"]).filter(inside).drop("_b")


def lookup(rows: DataFrame, table: DataFrame, on: str, value: str, default: Column) -> DataFrame:
    """``value`` of a dictionary table by its key, else ``default``; the key counts once."""
    once = table.groupBy(on).agg(F.min(value).alias(value))
    return rows.join(once, on, "left").withColumn(value, F.coalesce(F.col(value), default))


def instruction(rows: DataFrame, told: DataFrame, task: str, episode: str, text: str, wildcard: str = "*") -> DataFrame:
    """Text of (task, episode), else of (task, wildcard), else empty; told twice raises."""
    n = F.count(F.lit(1))
    once = told.groupBy(task, episode).agg(F.when(n > 1, F.raise_error(F.concat(F.lit("two instructions for "), F.col(episode)))).otherwise(F.first(text)).cast("string").alias("_t"))
    own = once.select(task, episode, F.col("_t").alias("_own"))
    any_ = once.filter(F.col(episode) == wildcard).select(task, F.col("_t").alias("_any"))
    return rows.join(own, [task, episode], "left").join(any_, task, "left").withColumn(text, F.coalesce("_own", "_any", F.lit(""))).drop("_own", "_any")


def intern(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a number in place of ``key``, and the dimension table (name, key)."""
    # dense numbers in key order, over the distinct keys: ranges first, then inside
    from kinelake.operators.temporal import sample_index

    dim = sample_index(rows.select(key).distinct().withColumn("_one", F.lit(1).cast("long")), [key], "_one").select(F.col("start").alias(name), key)
    joined = rows.join(dim, rows[key].eqNullSafe(dim[key]), "left").drop(dim[key])
    return joined.drop(key), dim


def english(text: Column) -> Column:
    """The part after the first ``@`` if the part before has Chinese characters and it is not blank."""
    at = F.instr(text, "@")
    before, after = F.substring(text, F.lit(1), at - 1), F.trim(F.substring(text, at + 1, F.length(text)))
    return F.when((at > 0) & before.rlike("[\\x{4e00}-\\x{9fff}]") & (after != ""), after).otherwise(text)


def align_cameras(rows: DataFrame, keys: list[str], camera: str, value: str, wanted: list[str]) -> DataFrame:
    """(keys, camera, position, value, present) for every wanted camera; others raise.

    An absent camera has a null value and ``present`` false; it never takes
    another one's.
    """
    known = F.map_from_arrays(F.array(*[F.lit(c) for c in wanted]), F.array(*[F.lit(i) for i in range(len(wanted))]))
    checked = rows.withColumn(camera, F.when(F.element_at(known, F.col(camera)).isNull(), F.raise_error(F.concat(F.lit("unknown camera "), F.col(camera)))).otherwise(F.col(camera)))
    by = checked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(camera, value))).alias("_m"))
    cells = F.array(*[F.struct(F.lit(c).alias(camera), F.lit(i).cast("long").alias("position"), F.element_at("_m", F.lit(c)).alias(value), F.map_contains_key("_m", F.lit(c)).alias("present")) for i, c in enumerate(wanted)])
    return by.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")

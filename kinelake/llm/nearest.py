"""The nearest record in time of the same entity, by expanding rings.

A ring is a bucket width. A left row asks its own and the two adjacent buckets;
whatever lies within one width of it is in them, so a match within the width
is the nearest there is. Rows without one go on to buckets twice as wide, up
to the tolerance. Rows of a dense entity start in finer buckets, so that a
bucket never holds more than a few right rows; in wider rings a half bucket is
known by its first and last row, as a left row that got there has none nearer.

Defined results: rows with null keys, time, tolerance or NaN times have no
match and no row; of right rows equally near the earlier one is taken, of those
at one time the smallest id; extra columns are ignored; empty sides give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import written


def _bucket(time: str, tol: str, level: int):
    """Buckets of ``tol / 2**level``."""
    return F.floor(F.col(time) / (F.col(tol) * F.lit(0.5**level)))


def _levels(right: DataFrame, keys: list[str], time: str, tol: str, level: int, most: int) -> tuple[DataFrame, int]:
    """(keys, _level) of the entities that need finer buckets than ``level``, and the finest level.

    Only rows of entities that are still too dense are counted again. Times are
    distinct, so buckets thin out; what no bucket number can tell apart any more
    (level 50) stays together, which costs time, not rows.
    """
    found: DataFrame | None = None
    rest = right
    while level < 50:
        by = rest.groupBy(*keys, _bucket(time, tol, level).alias("_b")).count().groupBy(*keys).agg(F.max("count").alias("_n"))
        dense = written(by.filter(F.col("_n") > most).select(*keys))
        if dense.isEmpty():
            break
        level += 1
        rest = rest.join(dense, keys, "left_semi")
        told = dense.withColumn("_level", F.lit(level))
        found = told if found is None else found.unionByName(told)
    if found is None:
        found = right.select(*keys, F.lit(level).alias("_level")).limit(0)
    return found.groupBy(*keys).agg(F.max("_level").alias("_level")), level


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, time: str = "t", tol: str = "tol", rings: int = 3, most: int = 32) -> DataFrame:
    """(left_id, keys, right_id, distance) of the nearest right row within ``tol``.

    ``tol`` is a column of both sides that depends on ``keys`` only. An entity's
    finest ring is ``tol / 2**(rings - 1)`` or as fine as leaves at most
    ``most`` right times in a bucket. Left ids may come with several keys.
    """
    known = [*keys, time, tol]

    def clean(df: DataFrame, id_: str) -> DataFrame:
        ok = df.select(*known, id_).dropna()
        return ok.filter(~F.isnan(time) & (F.col(tol) > 0))

    right = written(clean(right, right_id).groupBy(*known).agg(F.min(right_id).alias(right_id)))
    usual = rings - 1
    levels, finest = _levels(right, keys, time, tol, usual, most)
    fresh = clean(left, left_id)
    if finest > usual:
        levels = written(levels)
        right, fresh = (df.join(levels, keys, "left").withColumn("_level", F.coalesce("_level", F.lit(usual))) for df in (right, fresh))
        right, fresh = written(right), written(fresh)
    else:
        right, fresh = right.withColumn("_level", F.lit(usual)), fresh.withColumn("_level", F.lit(usual))
    todo: DataFrame | None = None
    found: list[DataFrame] = []
    for level in range(finest, -1, -1):
        enters = fresh.filter(F.col("_level") == level).drop("_level")
        todo = enters if todo is None else todo.unionByName(enters)
        base = right.filter(F.col("_level") == level).select(*known, right_id)
        wider = right.filter(F.col("_level") > level)
        if level < finest:
            half = [*keys, tol, _bucket(time, tol, level + 1).alias("_h")]
            ends = wider.groupBy(*half).agg(F.min(F.struct(time, right_id)).alias("_a"), F.max(F.struct(F.col(time), (-F.col(right_id)).alias("_n"))).alias("_z"))
            pick = F.array(F.col("_a"), F.struct(F.col(f"_z.{time}").alias(time), (-F.col("_z._n")).alias(right_id)))
            ends = ends.select(*keys, tol, F.explode(F.array_distinct(pick)).alias("_e")).select(*keys, F.col(f"_e.{time}").alias(time), tol, F.col(f"_e.{right_id}").alias(right_id))
            base = ends if level < usual else base.unionByName(ends)
        b = _bucket(time, tol, level)
        near = base.select(*keys, F.explode(F.array(b - 1, b, b + 1)).alias("_b"), F.col(time).alias("_rt"), F.col(right_id))
        distance = F.abs(F.col(time) - F.col("_rt"))
        joined = todo.withColumn("_b", b).join(near, [*keys, "_b"], "left")
        best = joined.groupBy(*keys, "_b", left_id, time, tol).agg(F.min(F.when(F.col("_rt").isNotNull(), F.struct(distance.alias("d"), F.col("_rt"), F.col(right_id)))).alias("_m"))
        best = best.select(*keys, left_id, time, tol, "_m", (F.coalesce(F.col("_m.d") <= F.col(tol) * F.lit(0.5**level), F.lit(False))).alias("_ok"))
        if level:
            best = written(best)
            todo = best.filter("not _ok").select(*known, left_id)
        found.append(best.filter("_ok").select(left_id, *keys, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.d").alias("distance")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out

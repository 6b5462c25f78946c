"""Exact statistics per dimension, and normalization with them."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.session import written

EPS = 1e-6


def long_form(rows: DataFrame, keys: list[str], vectors: list[str]) -> DataFrame:
    """(keys, field, dim, value) of the cells of several vector columns; null vectors have none."""
    none = F.array().cast("array<struct<field:string,dim:bigint,value:double>>")

    def listed(v: str) -> Column:
        return F.coalesce(F.transform(v, lambda x, i: F.struct(F.lit(v).alias("field"), i.cast("long").alias("dim"), x.cast("double").alias("value"))), none)

    cells = F.flatten(F.array(*map(listed, vectors)))
    return rows.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def moments(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, population deviation, smallest, largest and number, in double."""
    return cells.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count")
    )


def at_ranks(cells: DataFrame, by: list[str], ranks: dict[str, Callable[[Column], Column]], value: str = "value", most: int = 100_000) -> DataFrame:
    """(by, n, names): the values at ranks (from 0) of each group, exact, for groups of any size.

    ``ranks``: for each name a whole number made of the group's size. A counting
    pass over cells of log size finds those that hold the ranks; cells with more
    than ``most`` values that are not all equal are counted again in finer cells
    between their least and greatest value, until none is left. Only the
    distinct values of the last cells are sorted. No pass holds more than the
    counts of a group's cells. Null and NaN are left out.
    """
    x = cells.select(*by, F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_v is not null and not isnan(_v)")
    keys = [*by, "_g"]
    bits = 16
    log = F.log2(F.abs("_v")) * 64
    fine = F.when(F.abs("_v") == float("inf"), F.lit(1 << 20)).otherwise(F.floor(log) + (1 << 18))
    cell = F.when(F.col("_v") == 0, F.lit(0)).otherwise(F.signum("_v") * fine).cast("long")
    count = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    def held(counts: DataFrame, within: list[str]) -> DataFrame:
        """The cells that hold a rank, with the number of values before each."""
        run = W.partitionBy(*within).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        placed = counts.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
        hit = F.lit(False)
        for rank in ranks.values():
            r = rank(F.col("_n"))
            hit = hit | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
        return written(placed.filter(hit).select(*keys, "_lo", "_hi", "_c", "_before", "_n"))

    first = x.groupBy(*keys, cell.alias("_b")).agg(*count)
    first = first.withColumn("_base", F.lit(0).cast("long")).withColumn("_n", F.sum("_c").over(W.partitionBy(*keys)))
    wanted = held(first, keys)

    def inside() -> DataFrame:
        # a few rows per group
        same = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        few = wanted
        for k in keys:
            few = few.withColumnRenamed(k, f"_w{k}")
            same = same & F.col(k).eqNullSafe(F.col(f"_w{k}"))
        return x.join(few, same).drop(*[f"_w{k}" for k in keys])

    while (wanted.filter("_lo < _hi and _lo > double('-inf') and _hi < double('inf')").agg(F.max("_c")).first()[0] or 0) > most:
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        step = F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(share * (1 << bits)), F.lit((1 << bits) - 1))).otherwise(F.lit(0))
        finer = inside().withColumn("_b", step).withColumnsRenamed({"_lo": "_from", "_c": "_was", "_before": "_base"})
        wanted = held(finer.groupBy(*keys, "_from", "_base", "_n", "_b").agg(*count), [*keys, "_from"])
    distinct = inside().groupBy(*keys, "_lo", "_before", "_n", "_v").agg(F.count(F.lit(1)).alias("_k"))
    begin = F.col("_before") + F.coalesce(F.sum("_k").over(W.partitionBy(*keys, "_lo").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    row = distinct.withColumn("_at", begin)
    picks = [F.max(F.when((rank(F.col("_n")) >= F.col("_at")) & (rank(F.col("_n")) < F.col("_at") + F.col("_k")), F.col("_v"))).alias(name) for name, rank in ranks.items()]
    return row.groupBy(*keys).agg(F.max("_n").alias("n"), *picks).drop("_g")


def quantiles_bounded(cells: DataFrame, by: list[str], qs: dict[str, float], value: str = "value", most: int = 100_000) -> DataFrame:
    """Exact quantiles with linear interpolation, in bounded memory, for groups of any size (see :func:`at_ranks`)."""
    at = {name: (lambda n, q=q: F.lit(q) * (n - 1)) for name, q in qs.items()}
    ranks = {}
    for name, pos in at.items():
        ranks[f"{name}_low"] = lambda n, pos=pos: F.floor(pos(n))
        ranks[f"{name}_high"] = lambda n, pos=pos: F.ceil(pos(n))
    got = at_ranks(cells, by, ranks, value, most)

    def between(name: str) -> Column:
        share, low, high = at[name](F.col("n")) - F.floor(at[name](F.col("n"))), F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + F.when((share > 0) & (high > low), (high - low) * share).otherwise(0.0)).alias(name)

    return got.select(*by, *map(between, qs))


def quantiles(cells: DataFrame, by: list[str], qs: dict[str, float], value: str = "value") -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return quantiles_bounded(cells, by, qs, value)


def not_finite(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Numbers of NaN and infinite values per group."""
    v = F.col(value)
    return cells.groupBy(*by).agg(F.count_if(F.isnan(v)).alias("nan"), F.count_if(F.abs(v) == float("inf")).alias("inf"))


def require_finite(rows: DataFrame, vector: str) -> DataFrame:
    """The rows; NaN, infinite and null cells or a changed width raise."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    told = F.when(bad, F.raise_error(F.lit(f"{vector} is not finite")).cast(rows.schema[vector].dataType)).otherwise(F.col(vector))
    return rows.withColumn(vector, told)


def bounds(stats: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """Lower and upper value of the scale from columns q01, q99, min, max, quantile_fallback.

    A degenerate range falls back to min and max, a constant to +-0.5, only
    where ``quantile_fallback`` is 1.
    """
    c = stats or {k: F.col(k) for k in ("q01", "q99", "min", "max", "quantile_fallback")}
    narrow = (c["quantile_fallback"] == 1) & (c["q99"] - c["q01"] <= EPS)
    flat = narrow & (c["max"] - c["min"] <= EPS)
    lo = F.when(flat, c["min"] - 0.5).when(narrow, c["min"]).otherwise(c["q01"])
    hi = F.when(flat, c["max"] + 0.5).when(narrow, c["max"]).otherwise(c["q99"])
    return lo, hi


def normalize(x: Column, lo: Column, hi: Column, on: Column | None = None) -> Column:
    y = (x - lo) / (hi - lo + EPS) * 2 - 1
    return y if on is None else F.when(on, y).otherwise(x)


def unnormalize(y: Column, lo: Column, hi: Column, on: Column | None = None) -> Column:
    x = (y + 1) / 2 * (hi - lo + EPS) + lo
    return x if on is None else F.when(on, x).otherwise(y)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + EPS)


def unzscore(y: Column, mean: Column, std: Column) -> Column:
    return y * (std + EPS) + mean


def normalize_vectors(rows: DataFrame, stats: DataFrame, vector: str, field: str, mask: list[bool] | None = None, by: list[str] | None = None, invert: bool = False) -> DataFrame:
    """Vectors scaled by the stats rows (by, field, dim, q01, q99, ...) of ``field``.

    Stats are a few numbers per source and dim; they travel as one array row per
    source.
    """
    by = by or []
    lo, hi = bounds() if {"min", "max", "quantile_fallback"} <= set(stats.columns) else (F.col("q01"), F.col("q99"))
    ranges = stats.filter(F.col("field") == field).select(*by, "dim", lo.cast("float").cast("double").alias("lo"), hi.cast("float").cast("double").alias("hi"))
    packed = ranges.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dim", "lo", "hi"))).alias("_s"))
    joined = rows.join(packed, by, "left") if by else rows.join(packed.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left").drop("_one")
    on = F.array(*[F.lit(m) for m in mask]) if mask else None
    step = unnormalize if invert else normalize

    def cell(x: Column, i: Column) -> Column:
        s = F.get("_s", i)
        return step(x.cast("double"), s["lo"], s["hi"], None if on is None else F.coalesce(F.get(on, i), F.lit(True)))

    return joined.withColumn(vector, F.transform(vector, cell)).drop("_s")


def masked_error(rows: DataFrame, source: str, pred: str, actual: str, mask: Column) -> DataFrame:
    """(source, error, count, mse) of the masked squared error per source and, source null, of all."""
    e = F.when(mask, F.pow(F.col(pred) - F.col(actual), 2))
    by = rows.rollup(source).agg(F.coalesce(F.sum(e), F.lit(0.0)).alias("error"), F.count(e).alias("count"))
    return by.withColumn("mse", F.col("error") / F.nullif(F.col("count"), F.lit(0)))


def nearest_rank(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Mean and the values at index ``round((n - 1) q)``, half-even, of the sorted values; null and NaN are left out."""
    ranks = {k: (lambda n, q=q: F.rint((n - 1) * F.lit(q))) for k, q in qs.items()}
    picked = at_ranks(rows, by, ranks, value)
    mean = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.avg(value).alias("mean"))
    if not by:
        return picked.join(mean, F.lit(True)).select("mean", "n", *qs)
    keyed = mean.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "mean")
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    kind = rows.schema[value].dataType
    return picked.join(keyed, same).select(*by, "mean", "n", *[F.col(k).cast(kind).alias(k) for k in qs])


def parity(rows: DataFrame, by: list[str], actual: str, reference: str) -> DataFrame:
    """Sums of squares, dot product, largest difference, relative L2 and cosine of two columns; not finite raises."""
    a, r = F.col(actual).cast("double"), F.col(reference).cast("double")
    d = a - r
    bad = F.isnan(d) | (F.abs(d) == float("inf"))
    d = F.when(bad, F.raise_error(F.lit("values are not finite")).cast("double")).otherwise(d)
    got = rows.groupBy(*by).agg(
        F.sum(d * d).alias("error_sq"), F.sum(r * r).alias("reference_sq"), F.sum(a * a).alias("actual_sq"), F.sum(a * r).alias("dot"), F.max(F.abs(d)).alias("max_abs"), F.count(d).alias("count")
    )
    return with_ratios(got)


def with_ratios(got: DataFrame) -> DataFrame:
    l2 = F.sqrt(F.col("error_sq") / F.nullif(F.col("reference_sq"), F.lit(0.0)))
    cos = F.col("dot") / F.nullif(F.sqrt(F.col("reference_sq") * F.col("actual_sq")), F.lit(0.0))
    return got.withColumn("relative_l2", l2).withColumn("cosine", cos)


def merge_parity(parts: DataFrame, by: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("error_sq", "reference_sq", "actual_sq", "dot", "count")]
    return with_ratios(parts.groupBy(*by).agg(*sums, F.max("max_abs").alias("max_abs")))


def fingerprint(rows: DataFrame, by: list[str], text: Column) -> DataFrame:
    """A digest of a group's rows that does not depend on their order: sums of the parts of the rows' SHA-256, hashed.

    Sums are partial aggregates, so a group may have any size; repeated rows
    count as often as they come.
    """
    d = rows.select(*by, F.sha2(text, 256).alias("_d"))
    parts = [F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return d.groupBy(*by).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *parts), 256).alias("fingerprint"))


def save_stats(stats: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON file of a stats table (a few rows per source and dim), written whole or not at all; NaN raises."""
    rows = [r.asDict() for r in stats.collect()]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(fd, "w") as file:
            json.dump({"by": by or [], "stats": rows}, file, allow_nan=False)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def load_stats(spark, path: str) -> DataFrame:
    with open(path) as file:
        return spark.createDataFrame(json.load(file)["stats"])


def stats_name(kind: str, rep: str, format: str, freq: float, length: float | None = None) -> str:
    """A file name for stats; only relative actions depend on the horizon's length."""
    tail = f"_{length:g}s" if rep == "rel" and length is not None else ""
    return f"norm_{kind}_{rep}_{format}_{freq:g}hz{tail}.json"

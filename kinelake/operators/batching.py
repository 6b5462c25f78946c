"""Batches of ragged samples: padding, masks and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(df: DataFrame, name: str) -> tuple[str, bool]:
    """Simple type of the innermost cell, and whether there are two levels."""
    text = dict(df.dtypes)[name]
    inner = text.removeprefix("array<").removesuffix(">")
    deep = inner.startswith("array<")
    return (inner.removeprefix("array<").removesuffix(">") if deep else inner), deep


def pad_left_aligned(x: Column, size: Column, kind: str) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast(kind), (size - F.size(x)).cast("int")))


def pad_right_aligned(x: Column, size: Column, kind: str) -> Column:
    return F.concat(F.array_repeat(F.lit(0).cast(kind), (size - F.size(x)).cast("int")), x)


def pad_matrix(x: Column, rows: Column, width: Column, kind: str, right: bool = False) -> Column:
    """A (time, dim) array filled to rows x width: dims at the end, time at the end, or at the front if ``right``."""
    wide = F.transform(x, lambda r: pad_left_aligned(r, width, kind))
    empty = F.array_repeat(F.array_repeat(F.lit(0).cast(kind), width.cast("int")), (rows - F.size(x)).cast("int"))
    return F.concat(empty, wide) if right else F.concat(wide, empty)


def mask(size: Column, total: Column, right: bool = False) -> Column:
    """True where a padded axis holds data."""
    yes, no = F.array_repeat(F.lit(True), size.cast("int")), F.array_repeat(F.lit(False), (total - size).cast("int"))
    return F.concat(no, yes) if right else F.concat(yes, no)


def pad_batches(samples: DataFrame, batch: str, left: list[str], right: list[str] | None = None) -> DataFrame:
    """Vectors and matrices filled to the largest of their batch, each with ``<name>_mask`` along its first axis.

    ``left`` columns keep their front (actions, states), ``right`` ones their
    end (history). Sizes per batch are a small aggregate joined back; no batch
    is collected into a row. Null columns count as empty.
    """
    right = right or []
    names = [*left, *right]
    filled = samples
    for n in names:
        filled = filled.withColumn(n, F.coalesce(F.col(n), F.array().cast(dict(samples.dtypes)[n])))
    aggs = []
    for n in names:
        kind, deep = _kind(samples, n)
        aggs.append(F.max(F.size(n)).alias(f"_{n}_t"))
        if deep:
            aggs.append(F.max(F.coalesce(F.array_max(F.transform(n, F.size)), F.lit(0))).alias(f"_{n}_w"))
    sizes = filled.groupBy(batch).agg(*aggs)
    out = filled.join(sizes, batch)
    for n in names:
        kind, deep = _kind(samples, n)
        t = F.col(f"_{n}_t")
        at_end = n in right
        out = out.withColumn(f"{n}_mask", mask(F.size(n), t, at_end))
        if deep:
            out = out.withColumn(n, pad_matrix(F.col(n), t, F.col(f"_{n}_w"), kind, at_end))
        else:
            out = out.withColumn(n, (pad_right_aligned if at_end else pad_left_aligned)(F.col(n), t, kind))
    return out.drop(*[c for n in names for c in (f"_{n}_t", f"_{n}_w")])


def require_uniform(samples: DataFrame, batch: str, column: str) -> DataFrame:
    """Samples; a batch where only some have ``column`` raises."""
    n = samples.groupBy(batch).agg(F.count(column).alias("_some"), F.count(F.lit(1)).alias("_all"))
    mixed = F.when((F.col("_some") > 0) & (F.col("_some") < F.col("_all")), F.raise_error(F.concat(F.lit(f"samples with and without {column} in batch "), F.col(batch).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return samples.join(n, batch).withColumn("_ok", mixed).filter("_ok").drop("_ok", "_some", "_all")


def camera_union(samples: DataFrame, camera: str, order: list[str]) -> DataFrame:
    """(camera, position) of all cameras in the order of their first sample."""
    first = samples.groupBy(camera).agg(F.min(F.struct(*order)).alias("_f"))
    from pyspark.sql import Window as W

    return first.withColumn("position", F.row_number().over(W.orderBy("_f", camera)).cast("long") - 1).drop("_f")  # a row per camera


def fill_masks(batch: DataFrame, vectors: list[str], embodiment: str = "embodiment_id", unknown: int = 31) -> DataFrame:
    """All-true masks and the unknown embodiment where a stacked batch brings none."""
    out = batch
    for v in vectors:
        full = F.transform(v, lambda _: F.lit(True))
        out = out.withColumn(f"{v}_mask", F.coalesce(F.col(f"{v}_mask"), full) if f"{v}_mask" in batch.columns else full)
    told = F.col(embodiment) if embodiment in batch.columns else F.lit(None).cast("int")
    return out.withColumn(embodiment, F.coalesce(told, F.lit(unknown)))


def to_model(x: Column, dim: int, kind: str = "float") -> Column:
    """A vector filled to the model's width; a larger one raises."""
    big = F.raise_error(F.concat(F.lit("vector of "), F.size(x).cast("string"), F.lit(f" dims for a model of {dim}"))).cast(f"array<{kind}>")
    return F.when(F.size(x) > dim, big).otherwise(pad_left_aligned(x, F.lit(dim), kind))


def text_of(x: Column, kind: str) -> Column:
    """Text from text, bytes or the first entry of a list."""
    if kind.startswith("array"):
        return F.coalesce(F.try_element_at(x, F.lit(1)).cast("string"), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def cast_vectors(batch: DataFrame, kind: str, keep: tuple[str, ...] = ("history_offsets", "state_history_offsets")) -> DataFrame:
    """Float vectors as ``kind``; time offsets keep their precision."""
    out = batch
    for name, told in batch.dtypes:
        if name not in keep and told in ("array<float>", "array<double>"):
            out = out.withColumn(name, F.col(name).cast(f"array<{kind}>"))
        elif name not in keep and told in ("array<array<float>>", "array<array<double>>"):
            out = out.withColumn(name, F.col(name).cast(f"array<array<{kind}>>"))
    return out

"""Training math over rows: features of relative time, flow interpolation, conditioning on a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators import stats


def time_waves(offset: Column, waves: int, base: float = 10000.0) -> Column:
    """``array<struct<s, c>>``: sine and cosine less one of a relative time at ``waves`` falling frequencies; all 0 at time 0."""
    freq = F.transform(F.sequence(F.lit(0), F.lit(waves - 1)), lambda i: F.pow(F.lit(base), -i / F.lit(float(waves))))
    return F.transform(freq, lambda f: F.struct(F.sin(offset * f).alias("s"), (F.cos(offset * f) - 1).alias("c")))


def flow_point(x: Column, noise: Column, t: Column) -> Column:
    """Between the data (t = 0) and the noise (t = 1)."""
    return t * noise + (1 - t) * x


def flow_target(x: Column, noise: Column) -> Column:
    """The velocity from data to noise, which the model is to tell."""
    return noise - x


def flow_loss(rows: DataFrame, source: str, pred: str, x: str, noise: str, mask: Column) -> DataFrame:
    """Masked squared error of the predicted velocity per source and of all (:func:`stats.masked_error`)."""
    return stats.masked_error(rows.withColumn("_u", flow_target(F.col(x), F.col(noise))), source, pred, "_u", mask)


def with_prefix(chunk: Column, prefix: Column, steps: Column) -> Column:
    """A chunk of actions whose first ``steps`` are those of ``prefix``, as far as it has them; the rest stays.

    Null ``steps`` or ``prefix`` leave the chunk as it is.
    """
    known = F.least(F.coalesce(steps, F.lit(0)), F.coalesce(F.size(prefix), F.lit(0)))
    return F.transform(chunk, lambda a, k: F.when(k < known, F.get(prefix, k)).otherwise(a))


def normalized_prefix(prefix: Column, lo: list[float], hi: list[float], mask: list[bool] | None = None) -> Column:
    """A prefix of action vectors on the scale that the model works on; dimensions that ``mask`` leaves out stay."""
    low, high = F.array(*map(F.lit, map(float, lo))), F.array(*map(F.lit, map(float, hi)))
    on = F.array(*map(F.lit, mask if mask is not None else [True] * len(lo)))
    return F.transform(prefix, lambda a: F.transform(a, lambda v, i: stats.normalize(v.cast("double"), F.get(low, i), F.get(high, i), F.get(on, i))))

"""Orders, batches, splits and mixtures of samples.

Random choices are hashes of (seed, epoch, id): the same on any cluster, in any
order of rows, and resumable, instead of a generator's state.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.space import uniform
from kinelake.operators.temporal import sample_index


def _key(seed: int, epoch: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(c).cast("string") for c in cols]))


def shuffled(samples: DataFrame, ids: list[str], seed: int, epoch: int = 0) -> DataFrame:
    """Adds ``pos`` from 0 in the shuffled order of the epoch: each sample once.

    The order is that of a hash; positions come from ranges of the hash and
    ranks inside them, so no task sorts all samples.
    """
    keyed = samples.withColumn("_h", _key(seed, epoch, *ids)).withColumn("_one", F.lit(1).cast("long"))
    return sample_index(keyed, ["_h", *ids], "_one").withColumnRenamed("start", "pos").drop("stop", "_h", "_one")


def weighted_draws(spark, sources: list[tuple[str, float, int]], draws: int, seed: int, epoch: int = 0) -> DataFrame:
    """(pos, source, row) of draws with replacement: a source by weight times size, a row of it evenly.

    ``sources``: (name, weight, size), a few rows; the draw is an inverse
    distribution function in one expression, so draws need no join.
    """
    check_mixture(sources)
    total = sum(w * n for _, w, n in sources)
    cum, pick = 0.0, None
    for name, w, n in sources:
        cum += w * n
        this = F.struct(F.lit(name).alias("source"), F.lit(n).cast("long").alias("n"))
        last = name == sources[-1][0]
        pick = F.when(F.col("_u") < F.lit(cum / total), this) if pick is None else pick.otherwise(this) if last else pick.when(F.col("_u") < F.lit(cum / total), this)
    if len(sources) == 1:
        pick = F.struct(F.lit(sources[0][0]).alias("source"), F.lit(sources[0][2]).cast("long").alias("n"))
    u = spark.range(draws).select(F.col("id").alias("pos"), uniform(F.lit(str(seed)), F.lit(str(epoch)), F.lit("source"), F.col("id")).alias("_u"), uniform(F.lit(str(seed)), F.lit(str(epoch)), F.lit("row"), F.col("id")).alias("_v"))
    return u.select("pos", pick.alias("_p"), "_v").select("pos", "_p.source", F.least(F.floor(F.col("_v") * F.col("_p.n")), F.col("_p.n") - 1).cast("long").alias("row"))


def needs_replacement(weights: list[float]) -> bool:
    """Unequal weights draw with replacement, equal ones permute."""
    return len(set(weights)) > 1


def check_mixture(sources: list[tuple[str, float, int]]) -> None:
    if not sources:
        raise ValueError("a mixture needs a source")
    for name, w, n in sources:
        if not (math.isfinite(w) and w > 0):
            raise ValueError(f"{name}: weight {w}")
        if n <= 0:
            raise ValueError(f"{name}: no samples")


def cursor_batches(ordered: DataFrame, batch: int, world: int, total: int, start: int = 0, drop_last: bool = True) -> DataFrame:
    """Adds ``batch``, ``rank`` and ``slot``: batch b, rank r hold positions b*B*W + r*B and on; from batch ``start``."""
    width = batch * world
    n = total // width if drop_last else -(-total // width)
    if n == 0:
        raise ValueError(f"{total} samples make no batch of {batch} on {world} ranks")
    b = F.floor(F.col("pos") / width)
    out = ordered.withColumn("batch", b).withColumn("rank", F.floor(F.pmod("pos", F.lit(width)) / batch)).withColumn("slot", F.pmod("pos", F.lit(batch)))
    return out.filter((F.col("batch") >= start) & (F.col("batch") < n))


def seeds(samples: DataFrame, seed: int, epoch: int, pos: str = "pos") -> DataFrame:
    """A seed per sample that depends on seed, epoch and position alone."""
    return samples.withColumn("sample_seed", F.xxhash64(F.lit(seed), F.lit(epoch), pos))


def holdout_cut(groups: int, fraction: float) -> int:
    """Groups held out: the truncated share, at least one and not all."""
    if groups < 2:
        raise ValueError("a holdout needs two groups")
    return min(groups - 1, max(1, int(groups * fraction)))


def parent_identity(parent: Column, *own: Column) -> Column:
    """What episodes of one recording share: the parent if there is one, else the episode's own columns."""
    return F.coalesce(F.concat(F.lit("parent:"), parent.cast("string")), F.md5(F.concat_ws("\x1f", F.lit("own"), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in own])))


def holdout(rows: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``held``: whole groups, in order of their hash, until the cut.

    The cut's place in the hash order is found from counts of 4,096 hash ranges
    and the groups of one of them.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string")))
    groups = rows.select(group).distinct().withColumn("_h", h)
    counts = groups.groupBy(F.substring("_h", 1, 3).alias("p")).count().collect()  # at most 4096 rows
    left = holdout_cut(sum(r["count"] for r in counts), fraction)
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        if left <= n:
            limit = groups.filter(F.substring("_h", 1, 3) == p).orderBy("_h").select("_h").limit(left).agg(F.max("_h")).first()[0]
            break
        left -= n
    return rows.withColumn("held", h <= F.lit(limit))


def overlap(train: DataFrame, validation: DataFrame, group: str) -> DataFrame:
    """Groups on both sides; there must be none."""
    return train.select(group).intersect(validation.select(group))


def linspace(n: Column, take: Column, i: Column) -> Column:
    """The i-th of ``take`` even places in 0..n-1, truncated; one place is 0."""
    return F.when(take <= 1, F.lit(0)).otherwise(F.floor(i * (n - 1).cast("double") / (take - 1).cast("double") + 1e-12)).cast("long")


def balanced_counts(lengths: list[int], take: int) -> list[int]:
    """Frames of each episode when they are dealt one by one in rounds, at most its length."""
    active = [i for i, n in enumerate(lengths) if n > 0]
    if len(active) > take:
        places = [int(k * (len(active) - 1) / (take - 1)) if take > 1 else 0 for k in range(take)]
        active = [active[p] for p in places]
    counts, left = [0] * len(lengths), min(take, sum(lengths[i] for i in active))
    while left:
        open_ = [i for i in active if counts[i] < lengths[i]]
        whole = min(min(lengths[i] - counts[i] for i in open_), left // len(open_))
        if whole:
            for i in open_:
                counts[i] += whole
            left -= whole * len(open_)
        else:
            for i in open_[:left]:
                counts[i] += 1
            left = 0
    return counts


def balanced_sample(episodes: DataFrame, order: str, size: str, take: int) -> DataFrame:
    """(order, frame) of ``take`` frames spread over the episodes and evenly inside each.

    Quotas need no loop over episodes: with level L all episodes give up to L
    frames, and the first ones (by order) one more. L comes from a table of
    lengths and their numbers.
    """
    live = episodes.filter(F.col(size) > 0).select(order, F.col(size).cast("long").alias("_n"))
    total = live.count()
    if total > take:
        numbered = sample_index(live.withColumn("_one", F.lit(1).cast("long")), [order], "_one")
        places = [int(k * (total - 1) / (take - 1)) if take > 1 else 0 for k in range(take)]
        spark = episodes.sparkSession
        wanted = spark.createDataFrame([(p,) for p in places], "start long")
        return numbered.join(wanted, "start").select(order, F.lit(0).cast("long").alias("frame"))
    sizes = live.groupBy("_n").count().orderBy("_n").collect()  # one row per distinct length; total <= take
    left, level, open_ = take, 0, total
    for n, k in ((r["_n"], r["count"]) for r in sizes):
        if (n - level) * open_ > left:
            break
        left -= (n - level) * open_
        level, open_ = n, open_ - k
    if open_:
        level, left = level + left // open_, left % open_
    else:
        left = 0
    extra = live.filter(F.col("_n") > level).orderBy(order).limit(left).select(order, F.lit(1).alias("_more"))
    quota = live.join(extra, order, "left").withColumn("_q", F.least(F.col("_n"), F.lit(level) + F.coalesce("_more", F.lit(0)))).filter("_q > 0")
    return quota.select(order, "_n", "_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)).alias("_i")).select(order, linspace(F.col("_n"), F.col("_q"), F.col("_i")).alias("frame"))


def budgets(names: list[str], budget: int) -> dict[str, int]:
    """A budget dealt to sources: equal parts, the first ones one more."""
    return {n: budget // len(names) + (i < budget % len(names)) for i, n in enumerate(names)}


def rank_slices(ordered: DataFrame, world: int, total: int) -> DataFrame:
    """(rank, step, pos, valid): position p of rank p mod W; short ranks repeat the last one, not valid."""
    steps = -(-total // world)
    spark = ordered.sparkSession
    slots = spark.range(steps * world).select(F.col("id").alias("_slot"), F.least(F.col("id"), F.lit(total - 1)).alias("pos"))
    return slots.join(ordered, "pos").withColumn("rank", F.pmod("_slot", F.lit(world))).withColumn("step", F.floor(F.col("_slot") / world)).withColumn("valid", F.col("_slot") < total).drop("_slot")


def mixture(members: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """Members one after the other with ``source`` and ``weight``; missing columns are null."""
    if not members:
        raise ValueError("a mixture needs a member")
    out = None
    for name, weight, df in members:
        if not (math.isfinite(weight) and weight > 0):
            raise ValueError(f"{name}: weight {weight}")
        part = df.withColumn("source", F.lit(name)).withColumn("weight", F.lit(float(weight)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def shares(sizes: DataFrame, source: str, weight: str, n: str) -> DataFrame:
    """Expected share of draws of each source: weight times size over their sum."""
    x = F.col(weight) * F.col(n)
    return sizes.withColumn("share", x / F.sum(x).over(W.partitionBy()))  # a row per source


def save_cursor(path: str, seed: int, epoch: int, batch: int, signature: str) -> None:
    """Where a run stands in its order of samples, written whole or not at all."""
    import json
    import os

    with open(f"{path}.tmp", "w") as file:
        json.dump({"seed": seed, "epoch": epoch, "batch": batch, "signature": signature}, file)
    os.replace(f"{path}.tmp", path)


def load_cursor(path: str, signature: str) -> tuple[int, int, int]:
    """(seed, epoch, next batch) of a run over the same data; other data raise."""
    import json

    with open(path) as file:
        told = json.load(file)
    if told["signature"] != signature:
        raise ValueError("the cursor belongs to other data")
    return told["seed"], told["epoch"], told["batch"]

"""Records that belong together, and splits that keep them together.

Groups are the connected components of records and the keys they name. Labels
spread from keys to records by minimum, with pointer jumping, so the number of
rounds grows with the logarithm of the longest chain; each round is joins and
partial aggregates over all rows, and its result is cut in the shared folder.

The split places large groups first, largest first, where most room is left
in the whole table. The others start from a hashed assignment to what is left
of the wanted sizes and label shares and are improved by component swap
search: groups are dealt into random shards, each of which anneals towards its
part of what the whole table still lacks, exchanging or moving whole groups;
the best state of each shard is kept. What is lacking is counted and shards
are dealt anew in the next round.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import discard, written


def components(edges: DataFrame, record: str = "record_id", key: str = "key", salts: int = 64) -> DataFrame:
    """(record, group_id): the smallest record of the component, for records that share a key.

    ``edges``: (record, key) rows; null records and keys link nothing, repeated
    rows count once. Records whose keys are theirs alone have no row. A key may
    belong to any share of the rows: it is a star of ``salts`` stars, each row
    linked to the smallest of its salt and these to the smallest of all.
    """
    edges = edges.select(F.col(record).alias("r"), F.col(key).alias("k")).dropna().withColumn("s", F.pmod(F.xxhash64("r"), F.lit(salts)))
    edges = written(edges)
    salted = edges.groupBy("k", "s").agg(F.min("r").alias("c"), F.max("r").alias("z"))
    heads = salted.groupBy("k").agg(F.min("c").alias("m"), F.max("z").alias("z")).filter("z > m").select("k", "m")
    inner = edges.join(salted.filter("z > c").select("k", "s", "c"), ["k", "s"]).filter("r <> c").select("r", F.col("c").alias("m"))
    outer = salted.join(heads, "k").filter("c <> m").select(F.col("c").alias("r"), "m")
    links = written(inner.union(outer).distinct())
    discard(edges)
    both = links.union(links.select("m", "r")).toDF("a", "b")
    labels = written(links.select("r").union(links.select("m")).distinct().select("r", F.col("r").alias("l")))
    while True:
        # smallest label among a record's neighbours
        seen = both.join(labels.withColumnRenamed("r", "b"), "b").groupBy("a").agg(F.min("l").alias("n"))
        hooked = labels.join(seen, F.col("r") == F.col("a"), "left").select("r", "l", F.least("l", "n").alias("n"))
        # the label's own label may be smaller still; it also learns from its followers
        lower = hooked.groupBy("l").agg(F.min("n").alias("n")).filter("n < l")
        told = lower.select(F.col("l").alias("r"), F.col("n").alias("t"))
        step = written(hooked.join(told, "r", "left").select("r", F.col("l").alias("was"), F.least("n", "t").alias("l")))
        for _ in range(2):
            jumped = written(_jump(step, salts))
            discard(step)
            step = jumped
        moved = not step.filter("l <> was").isEmpty()
        discard(labels)
        labels = step.select("r", "l")
        labels._kinelake_path = step._kinelake_path
        if not moved:
            discard(links)
            return labels.select(F.col("r").alias(record), F.col("l").alias("group_id"))


def _jump(step: DataFrame, salts: int) -> DataFrame:
    """Each record with the label of its label.

    Only labels that have another label are joined, and of a label that many
    records have each salt is a key of its own.
    """
    used = step.groupBy("l").agg(F.lit(1).alias("_u"))
    next_ = step.filter("l <> r").select(F.col("r").alias("l"), F.col("l").alias("j")).join(used, "l", "left_semi")
    each = next_.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return step.withColumn("_s", F.pmod(F.xxhash64("r"), F.lit(salts)).cast("int")).join(each, ["l", "_s"], "left").select("r", "was", F.least("l", "j").alias("l"))


def _anneal(size: np.ndarray, hist: np.ndarray, aim: np.ndarray, aims: np.ndarray, part: np.ndarray, seed: int, steps: int, heat: float) -> np.ndarray:
    """The best split of groups found; cost: squared deviations from the sizes and the label counts aimed at per split."""
    r = np.random.default_rng(seed)
    n, k = len(size), len(aim)
    total, labels = size.sum(), hist.sum(0)
    weight = 1.0 / np.maximum(labels, 1)
    s = np.bincount(part, size, minlength=k)
    h = np.zeros((k, hist.shape[1]))
    np.add.at(h, part, hist)
    cost = (((s - aim) / total) ** 2).sum() * 4 + (((h - aims) ** 2) * weight).sum() / max(total, 1)
    best, best_cost = part.copy(), cost
    for t in range(steps):
        i = int(r.integers(n))
        a = part[i]
        b = int(r.integers(k - 1)) if k > 1 else a
        b += b >= a
        j = -1
        if r.random() < 0.5:
            j = int(r.integers(n))
            if part[j] != b:
                j = -1
        ds, dh = size[i] - (size[j] if j >= 0 else 0), hist[i] - (hist[j] if j >= 0 else 0)
        rows = [a, b]
        old = ((((s[rows] - aim[rows]) / total) ** 2).sum() * 4) + (((h[rows] - aims[rows]) ** 2) * weight).sum() / total
        ns, nh = s[rows] + (-ds, ds), h[rows] + np.stack([-dh, dh])
        new = ((((ns - aim[rows]) / total) ** 2).sum() * 4) + (((nh - aims[rows]) ** 2) * weight).sum() / total
        d = new - old
        if d <= 0 or r.random() < np.exp(-d / (heat * (1 - t / steps) + 1e-12)):
            s[rows], h[rows] = ns, nh
            part[i] = b
            if j >= 0:
                part[j] = a
            cost += d
            if cost < best_cost - 1e-12:
                best, best_cost = part.copy(), cost
    return best


def _place(size: np.ndarray, hist: np.ndarray, want: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Splits of large groups, largest first: where they exceed the wanted size least, then where they fit the label shares best."""
    total, aims = labels.sum(), labels * want[:, None]
    weight = 1.0 / np.maximum(labels, 1)
    room, lack = total * want, aims.copy()
    part = np.zeros(len(size), np.int64)
    for i in np.argsort(-size, kind="stable"):
        over = np.maximum(size[i] - np.maximum(room, 0), 0)
        cost = size[i] * (size[i] - 2 * room) / total**2 * 4 + (hist[i] * (hist[i] - 2 * lack) * weight).sum(1) / total
        part[i] = np.lexsort((cost, over))[0]
        room[part[i]] -= size[i]
        lack[part[i]] -= hist[i]
    return part


def _portion(lack: np.ndarray, shard: int, shards: int) -> np.ndarray:
    """What one of ``shards`` is to gain of ``lack`` (splits x labels), in whole records; all portions add up to it."""
    upto = [np.round(lack[:-1] * x / shards) for x in (shard, shard + 1)]
    gain = upto[1] - upto[0]
    return np.concatenate([gain, -gain.sum(0, keepdims=True)])


def split(records: DataFrame, group: DataFrame, shares: dict[str, float], record: str = "record_id", label: str | None = None, rounds: int = 2, shard_groups: int = 4000, steps: int = 6000, seed: int = 7, labels: int = 64) -> DataFrame:
    """(record, group_id, split): whole groups in one split, near the wanted shares overall and by label.

    A record without a row in ``group`` is its own group. Labels (a string
    column, null is one of them) are hashed into ``labels`` classes. A shard
    holds about ``shard_groups`` groups at any table size; groups of more than a
    twentieth of a shard's records, the ``shard_groups`` largest at most, are
    placed before the others.
    """
    names = list(shares)
    want = np.array([shares[n] for n in names], float)
    want /= want.sum()
    base = records.select(record, (F.col(label) if label else F.lit("")).alias("_label")).filter(F.col(record).isNotNull())
    base = base.groupBy(record).agg(F.min(F.coalesce("_label", F.lit("\0"))).alias("_label"))
    base = written(base.join(group.select(record, "group_id"), record, "left").withColumn("group_id", F.coalesce("group_id", record)))
    cls = F.pmod(F.xxhash64("_label"), F.lit(labels)).cast("int")
    # per group: (class, count) pairs; at most ``labels`` of them
    parts = base.groupBy("group_id", cls.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("group_id").agg(F.collect_list(F.struct("c", "n")).alias("h"), F.sum("n").alias("size"))
    groups = written(groups)
    n = max(1, groups.count())
    shards = max(1, -(-n // shard_groups))
    schema = "group_id long, h array<struct<c:int,n:long>>, size long, part int"
    spark = records.sparkSession

    # label totals of the table, then large groups: at most ``labels`` and ``shard_groups`` rows
    whole = np.zeros(labels)
    for c, k in base.groupBy(cls.alias("c")).count().collect():
        whole[c] = k
    large = groups.filter(F.col("size") > float(whole.sum()) / shards / 20).orderBy(F.desc("size"), "group_id").limit(shard_groups).collect()

    def matrix_of(column: Iterable) -> np.ndarray:
        hist = np.zeros((len(column), labels))
        for i, pairs in enumerate(column):
            for x in pairs:
                hist[i, x["c"]] += x["n"]
        return hist

    first = matrix_of([x["h"] for x in large])
    placed = _place(np.array([x["size"] for x in large], float), first, want, whole)
    held = np.zeros((len(names), labels))
    np.add.at(held, placed, first)
    head = spark.createDataFrame([(x["group_id"], int(k)) for x, k in zip(large, placed)], "group_id long, part int")
    # the others start by the shares of what is left of their main label, which are the wanted ones if nothing is placed
    left = np.maximum(whole * want[:, None] - held, 0)
    left = np.where(left.sum(0) > 0, left / np.maximum(left.sum(0), 1e-12), want[:, None])
    edges = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in np.cumsum(left, 0).T])
    main = F.array_max(F.transform("h", lambda x: F.struct(x["n"].alias("n"), x["c"].alias("c"))))["c"]
    u = (F.pmod(F.xxhash64(F.lit(seed), "group_id"), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    start = F.least(F.size(F.filter(F.element_at(edges, main + 1), lambda x: x <= u)), F.lit(len(names) - 1))
    state = written(groups.join(F.broadcast(head.select("group_id")), "group_id", "left_anti").withColumn("part", start.cast("int")))

    for r in range(rounds if len(names) > 1 else 0):
        lack = whole * want[:, None] - held
        for k, c, m in state.select("part", F.explode("h").alias("x")).groupBy("part", "x.c").agg(F.sum("x.n")).collect():
            lack[k, c] -= m

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("group_id").reset_index(drop=True)
            hist, part = matrix_of(pdf["h"]), pdf["part"].to_numpy(np.int64).copy()
            gain = _portion(lack, int(key[0]), shards)  # noqa: B023
            aims = gain.copy()
            np.add.at(aims, part, hist)
            used = hist.sum(0) > 0
            aim = aims.sum(1)
            best = _anneal(pdf["size"].to_numpy(float), hist[:, used], aim, aims[:, used], part, int(key[0]) + seed, steps, 1e-5)
            return pdf[["group_id", "h", "size"]].assign(part=best.astype(np.int32))

        dealt = state.withColumn("_shard", F.pmod(F.xxhash64(F.lit(r), F.lit(seed), "group_id"), F.lit(shards)))
        # as many tasks as shards: groups are few bytes and much work
        better = written(dealt.repartition(shards, "_shard").groupBy("_shard").applyInPandas(run, schema))
        discard(state)
        state = better
    state = state.select("group_id", "part").union(head)
    named = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("part") + 1)
    return base.join(state.select("group_id", named.alias("split")), "group_id").select(record, "group_id", "split")

"""A training mix whose sources have their target shares of the total size.

The records of a source, in hashed order, form one line of frames that is cut
into blocks of fixed length. The mix is made of shards of slots; each shard
draws multinomial counts of the sources, the slots of a source are numbered
over all shards, and slot ``j`` takes block ``perm(j mod blocks)`` of repeat
``j div blocks``, ``perm`` a pseudorandom permutation per source and repeat.
Blocks are joined by index. The mix is as large as the source that is used up
first allows at its share. Slots that the draws give a source beyond its cap
(repeats times blocks) go to sources below theirs, in proportion to the room
they have; none is left empty.

Defined results: a repeated record id counts once; records without a positive
size have no frames and are in no block; sources without frames or with weight
0 have no share, null and NaN weights are 1; a null cap is 1 use; the last
block of a source is shorter; no sources give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.temporal import running
from kinelake.session import written

def sized(records: DataFrame, source: str, record: str, size: str) -> DataFrame:
    """(source, record, size) of the records with frames, each id once."""
    base = records.select(F.col(source).alias("source"), F.col(record).alias("record"), F.col(size).cast("long").alias("size"))
    return base.filter("source is not null and record is not null and size > 0").groupBy("record").agg(F.min("source").alias("source"), F.max("size").alias("size")).select("source", "record", "size")


def lines(records: DataFrame, source: str, record: str, size: str, seed: int) -> DataFrame:
    """(source, record, size, begin): where each record begins in its source's line.

    Prefix sums in two levels, over ranges of hashes and inside, so that no
    source is one task.
    """
    base = sized(records, source, record, size).withColumn("h", F.xxhash64(F.lit(seed), "record"))
    return running(base, ["source"], ["h", "record"], "size").select("source", "record", "size", F.col("before").alias("begin"))


def blocks(line: DataFrame, length: int) -> DataFrame:
    """(source, block, at, record, frame_from, n_frames): the pieces of each block in order."""
    first, last = F.floor(F.col("begin") / length), F.floor((F.col("begin") + F.col("size") - 1) / length)
    cutup = line.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest("begin", F.col("block") * length)
    hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * length)
    return cutup.select("source", "block", (lo - F.col("block") * length).alias("at"), "record", (lo - F.col("begin")).alias("frame_from"), (hi - lo).alias("n_frames"))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 per key: a Feistel network, walked until it is inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    size = n.astype(np.uint64)
    with np.errstate(over="ignore"):
        while todo.any():
            x, m, hb, k = out[todo], mask[todo], half[todo], key[todo].astype(np.uint64)
            left, right = x >> hb, x & m
            for r in range(4):
                f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ k * np.uint64(0xC2B2AE3D27D4EB4F)
                f ^= f >> np.uint64(31)
                f *= np.uint64(0xD6E8FEB86659FD93)
                left, right = right, left ^ (f >> np.uint64(17)) & m
            out[todo] = left << hb | right
            todo = out >= size
    return out.astype(np.int64)


def plan(sources: pd.DataFrame, length: int, slots: int) -> tuple[pd.DataFrame, int]:
    """Shares, blocks and caps of the sources, and the number of slots.

    ``sources``: name, weight, max_repeats, frames; one row per source.
    """
    s = sources.copy()
    s["weight"] = s["weight"].astype(float).fillna(1.0).clip(lower=0.0)
    s["max_repeats"] = s["max_repeats"].fillna(1).clip(lower=0).astype(int)
    s["frames"] = s["frames"].fillna(0).astype("int64")
    live = (s["weight"] > 0) & (s["frames"] > 0) & (s["max_repeats"] > 0)
    s["share"] = np.where(live, s["weight"], 0.0) / max(s.loc[live, "weight"].sum(), 1e-300)
    s["blocks"] = -(-s["frames"] // length)
    cap = (s["blocks"] * s["max_repeats"]).where(live, 0)
    # the largest number of slots at which no source's share is beyond its cap
    total = max(1, int((cap[live] / s.loc[live, "share"]).min() + 1e-9)) if live.any() else 0
    s["cap"] = cap.astype("int64")
    return s, total


def overflow(drawn: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where slots beyond a source's cap go: (first number of each source's among all these, upper ends of the intervals
    that sources take of them, number of such slots). They are shared out in proportion to the room that is left.
    """
    over, room = np.maximum(drawn - cap, 0), np.maximum(cap - drawn, 0)
    total = int(over.sum())
    share = [int(r) * total // max(int(room.sum()), 1) for r in room]
    for i in np.argsort(-room, kind="stable"):  # what rounding leaves, to those with most room
        extra = min(int(room[i]) - share[i], total - sum(share))
        share[i] += extra
    return np.cumsum(over) - over, np.cumsum(share), over


def mix(records: DataFrame, sources: DataFrame, source: str, record: str, size: str, length: int = 64, slots: int = 256, seed: int = 11) -> DataFrame:
    """(shard, slot, source, repeat, record, frame_from, n_frames) of the mix.

    ``sources`` is a catalog (name, weight, max_repeats), small by nature; one
    row of sums per source goes to the driver, nothing of the records.
    """
    spark = records.sparkSession
    line = written(lines(records, source, record, size, seed))
    named = sources.groupBy("name").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    frames = line.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("frames"))
    s, total = plan(named.join(frames, "name", "left").orderBy("name").toPandas(), length, slots)
    names, share = s["name"].tolist(), s["share"].to_numpy()
    shards = -(-total // slots)
    counts = "shard long, source string, n long"

    def draw(parts):
        for pdf in parts:
            rows = []
            for shard in pdf["id"]:
                width = min(slots, total - int(shard) * slots)
                n = np.random.default_rng([seed, int(shard)]).multinomial(width, share)
                rows += [(int(shard), names[i], int(n[i])) for i in np.flatnonzero(n)]
            yield pd.DataFrame(rows, columns=["shard", "source", "n"]).astype({"shard": "int64", "source": "object", "n": "int64"})

    drawn = spark.range(shards).mapInPandas(draw, counts) if total else spark.createDataFrame([], counts)
    # numbers of a source's slots over all shards, again by two levels
    drawn = written(drawn.withColumn("bucket", F.floor(F.col("shard") / 4096)))
    outer = drawn.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
    outer = outer.withColumn("base", F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = W.partitionBy("source", "bucket").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    numbered = drawn.join(outer, ["source", "bucket"]).withColumn("first", F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    before = W.partitionBy("shard").orderBy("source").rowsBetween(W.unboundedPreceding, -1)
    numbered = numbered.withColumn("slot0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    each = numbered.select("shard", "source", "first", "slot0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    limits = {r.name: (int(r.blocks), int(r.cap)) for r in s.itertuples(index=False)}
    order = {n: i for i, n in enumerate(names)}
    told = dict(drawn.groupBy("source").agg(F.sum("n")).collect())  # a row per source
    got = np.array([told.get(n, 0) for n in names], np.int64)
    size_of, cap_of = (np.array([limits[n][k] for n in names], np.int64) for k in (0, 1))
    first_over, ends, _ = overflow(got, cap_of)
    label = np.array(names, object)

    def place(parts):
        for pdf in parts:
            of = np.array([order[x] for x in pdf["source"]], np.int64)
            j = (pdf["first"] + pdf["k"]).to_numpy(np.int64)
            over = np.flatnonzero(j >= cap_of[of])
            if len(over):
                number = first_over[of[over]] + j[over] - cap_of[of[over]]
                to = np.searchsorted(ends, number, "right")
                j[over] = got[to] + number - np.where(to > 0, ends[np.maximum(to - 1, 0)], 0)
                of[over] = to
            n = size_of[of]
            repeat = j // n
            key = of * 65537 + repeat * 31 + seed
            # slots of a shard are in pseudorandom order, too
            width = np.minimum(slots, total - pdf["shard"].to_numpy(np.int64) * slots)
            slot = permute((pdf["slot0"] + pdf["k"]).to_numpy(np.int64), width, pdf["shard"].to_numpy(np.int64) + seed)
            yield pd.DataFrame({"shard": pdf["shard"], "slot": slot, "source": label[of], "repeat": repeat, "block": permute(j % n, n, key)})

    placed = each.mapInPandas(place, "shard long, slot long, source string, repeat long, block long")
    return placed.join(blocks(line, length), ["source", "block"]).select("shard", "slot", "at", "source", "repeat", "record", "frame_from", "n_frames")


def shares(mixed: DataFrame, sources: DataFrame, seen: DataFrame) -> DataFrame:
    """Per catalog entry: weight, target share among sources with frames, frames in the mix, actual share.

    ``seen``: (name, frames) of the sources' records.
    """
    named = sources.groupBy("name").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")).join(seen, "name", "left")
    w = F.when(F.coalesce("frames", F.lit(0)) > 0, F.greatest(F.coalesce(F.nanvl("weight", F.lit(1.0)), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    got = mixed.groupBy(F.col("source").alias("name")).agg(F.sum("n_frames").alias("mixed"))
    all_ = W.partitionBy()  # one row per catalog entry
    out = named.withColumn("w", w).join(got, "name", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    return out.select("name", "weight", "max_repeats", F.coalesce("frames", F.lit(0)).alias("frames"), "mixed", F.round(F.col("w") / F.sum("w").over(all_), 6).alias("target_share"), F.round(F.col("mixed") / F.sum("mixed").over(all_), 6).alias("actual_share"), F.round(F.col("mixed") / F.col("frames"), 4).alias("uses"))

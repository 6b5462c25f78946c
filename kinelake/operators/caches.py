"""Payload packs, feature shards and the checks that let them be used again."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.temporal import running


def pack_offsets(payloads: DataFrame, keys: list[str], order: list[str], length: str) -> DataFrame:
    """Adds ``offset``: where each payload of a pack begins, by sums in two levels, so that no pack is one task."""
    return running(payloads, keys, order, length).withColumnRenamed("before", "offset")


def pack_faults(index: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """(keys, gaps, empty, total, size): packs whose offsets have gaps, with empty payloads or another size than told."""
    w = W.partitionBy(*keys).orderBy("offset", "length")
    expected = F.coalesce(F.lag("offset").over(w) + F.lag("length").over(w), F.lit(0))
    by = index.withColumn("_gap", F.col("offset") != expected).groupBy(*keys).agg(F.count_if("_gap").alias("gaps"), F.count_if(F.col("length") <= 0).alias("empty"), F.sum("length").alias("total"))
    by = by.join(sizes, keys, "left") if sizes is not None else by.withColumn("size", F.col("total"))
    return by.filter("gaps > 0 or empty > 0 or size is null or total <> size")


def pack_gather(wanted: DataFrame, index: DataFrame, keys: list[str], at: str, frame: str, values: list[str]) -> DataFrame:
    """Payload entries of wanted frame numbers, clamped to the pack."""
    n = index.groupBy(*keys).agg((F.max(frame)).alias("_last"))
    clamped = wanted.join(n, keys).withColumn("_f", F.greatest(F.least(F.col(at), F.col("_last")), F.lit(0)))
    return clamped.join(index.select(*keys, F.col(frame).alias("_f"), *values), [*keys, "_f"]).withColumnRenamed("_f", "src").drop("_last")


def step_frames(steps: DataFrame, keys: list[str], ts: str, frames: Column, begin: Column | None = None) -> DataFrame:
    """Adds ``src``: the video frame of each step, at the rate of the median step, clipped to the video.

    Episodes with as many frames as steps map one to one; a single step is frame 0.
    """
    w = W.partitionBy(*keys).orderBy(ts)
    diff = steps.withColumn("_d", F.col(ts) - F.lag(ts).over(w)).withColumn("_i", F.row_number().over(w).cast("long") - 1)
    by = diff.groupBy(*keys).agg(F.percentile("_d", 0.5).alias("_m"), F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_t0"))
    fps = 1 / F.nullif(F.col("_m"), F.lit(0.0))
    start = F.lit(0.0) if begin is None else begin
    at = F.rint((F.col(ts) + start) * fps).cast("long")
    src = F.when(frames == F.col("_n"), F.col("_i")).otherwise(F.greatest(F.least(F.coalesce(at, F.lit(0)), frames - 1), F.lit(0)))
    return diff.join(by, keys).withColumn("src", src.cast("long")).drop("_d", "_i", "_m", "_n", "_t0")


def distinct_streams(streams: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each stream in the order given."""
    return streams.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def path_number(path: Column) -> Column:
    """A 32-bit number of a path from its MD5."""
    return F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long")


def shard_plan(rows: DataFrame, row: str, size: int) -> DataFrame:
    return rows.withColumn("shard", F.floor(F.col(row) / size))


def pending(planned: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return planned.join(done.select(*on).distinct(), on, "left_anti")


def shard_lookup(wanted: DataFrame, shards: DataFrame, row: str, start: str = "start", stop: str = "stop", width: int = 65536) -> DataFrame:
    """Wanted rows with their shard and place in it; order and repeats stay.

    A range join by bucket of row numbers, so neither side is broadcast by
    assumption.
    """
    listed = shards.filter(F.col(start) < F.col(stop)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    met = wanted.withColumn("_b", F.floor(F.col(row) / width)).join(listed, "_b")
    return met.filter((F.col(row) >= F.col(start)) & (F.col(row) < F.col(stop))).withColumn("place", F.col(row) - F.col(start)).drop("_b")


def range_faults(ranges: DataFrame, start: str, stop: str, rows: int) -> DataFrame:
    """Source ranges that do not tile 0..rows: those that begin elsewhere than the one before ends, and a wrong end."""
    w = W.orderBy(start, stop)  # a row per source
    before = F.coalesce(F.lag(stop).over(w), F.lit(0))
    last = F.lead(start).over(w).isNull() & (F.col(stop) != rows)
    return ranges.withColumn("_bad", (F.col(start) != before) | last | (F.col(stop) < F.col(start))).filter("_bad").drop("_bad")


def require_fields(df: DataFrame, contract: dict[str, tuple[str, int]]) -> DataFrame:
    """Rows whose list fields have the type and width told; drift raises."""
    kinds = dict(df.dtypes)
    for name, (kind, width) in contract.items():
        if kinds.get(name) != f"array<{kind}>":
            raise TypeError(f"{name} is {kinds.get(name)}, not array<{kind}>")
        bad = F.raise_error(F.concat(F.lit(f"{name} has "), F.size(name).cast("string"), F.lit(f" cells, not {width}"))).cast(f"array<{kind}>")
        df = df.withColumn(name, F.when(F.size(name) == width, F.col(name)).otherwise(bad))
    return df


def canonical(contract: dict) -> str:
    return json.dumps(contract, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def content_path(root: str, contract: dict) -> str:
    """A folder named by what it holds."""
    return os.path.join(root, hashlib.sha256(canonical(contract).encode()).hexdigest()[:24])


def write_shards(rows: DataFrame, path: str, contract: dict, row: str = "row_id", shard_rows: int = 1024) -> int:
    """Write the shards that are not there yet; returns how many were written.

    A folder with another contract raises. Each shard is a folder of its own
    and counts once its marker file names its rows; the manifest comes last.
    """
    manifest = os.path.join(path, "manifest.json")
    told = {"contract": contract, "shard_rows": shard_rows}
    os.makedirs(path, exist_ok=True)
    head = os.path.join(path, "contract.json")
    if os.path.exists(head):
        with open(head) as file:
            if json.load(file) != json.loads(json.dumps(told)):
                raise ValueError(f"{path} holds another contract")
    else:
        with open(head, "w") as file:
            json.dump(told, file)
    planned = shard_plan(rows, row, shard_rows)
    done = [int(d.name.removeprefix("done-").removesuffix(".json")) for d in os.scandir(path) if d.name.startswith("done-")]
    spark = rows.sparkSession
    todo = pending(planned, spark.createDataFrame([(d,) for d in done], "shard long"), ["shard"])
    # a shard is written over whole, so rows that an interrupted run left without a marker are not there twice
    todo.repartition("shard").sortWithinPartitions("shard", row).write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(os.path.join(path, "rows"))
    fresh = 0
    if os.path.isdir(os.path.join(path, "rows")):
        counts = spark.read.parquet(os.path.join(path, "rows")).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(row).alias("ids"))
        written_ = pending(counts, spark.createDataFrame([(d,) for d in done], "shard long"), ["shard"])
        for r in written_.toLocalIterator():
            if r["rows"] != r["ids"]:
                raise ValueError(f"shard {r['shard']} holds a {row} twice")
            marker = os.path.join(path, f"done-{r['shard']}.json")
            with open(marker + ".tmp", "w") as file:
                json.dump({"rows": r["rows"]}, file)
            os.replace(marker + ".tmp", marker)
            fresh += 1
        shards, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    else:
        shards = total = 0
    with open(manifest + ".tmp", "w") as file:
        json.dump(told | {"rows": total, "shards": shards}, file)
    os.replace(manifest + ".tmp", manifest)
    return fresh


def read_shards(spark, path: str, contract: dict | None = None) -> DataFrame:
    """Rows of a finished cache; one without manifest, with another contract or row count raises."""
    try:
        with open(os.path.join(path, "manifest.json")) as file:
            manifest = json.load(file)
    except FileNotFoundError:
        raise ValueError(f"{path} is not finished") from None
    if contract is not None and json.loads(json.dumps(contract)) != manifest["contract"]:
        raise ValueError(f"{path} holds another contract")
    df = spark.read.parquet(os.path.join(path, "rows"))
    if df.count() != manifest["rows"]:
        raise ValueError(f"{path} holds another number of rows")
    return df


def source_tag(path: Column, modified_ms: Column, size: Column, *more: Column) -> Column:
    """What a cache entry depends on, as one digest: another file, time, size or option is another tag."""
    return F.sha2(F.concat_ws("|", path, *[F.coalesce(c.cast("string"), F.lit("-")) for c in (modified_ms, size, *more)]), 256)


def file_digests(spark, path: str) -> DataFrame:
    """(file, bytes, sha256) of every data file below a folder, hashed where it is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return raw.select(F.regexp_replace("path", "^.*?" + path.rstrip("/") + "/", "").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def seal(spark, path: str) -> int:
    """Write the digests of a finished cache beside its rows; returns the number of files."""
    found = file_digests(spark, os.path.join(path, "rows"))
    found.write.mode("overwrite").parquet(os.path.join(path, "digests"))
    return spark.read.parquet(os.path.join(path, "digests")).count()


def seal_faults(spark, path: str) -> DataFrame:
    """Files of a sealed cache that are gone, new or changed."""
    told = spark.read.parquet(os.path.join(path, "digests")).withColumnRenamed("sha256", "told").drop("bytes")
    now = file_digests(spark, os.path.join(path, "rows"))
    return told.join(now, "file", "full").filter(~F.col("told").eqNullSafe(F.col("sha256")))


def require_all(planned: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """The plan, if a cache holds all of it; else it raises with an example of what is missing."""
    missing = pending(planned.select(*on), done, on).limit(1).collect()
    if missing:
        raise ValueError(f"not in the cache: {missing[0].asDict()}")
    return planned

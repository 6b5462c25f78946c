"""Many small files in few indexed containers.

A container is one large block of original bytes, one after the other; the
index has a row per entry with path, offset, length and checksum, so that any
entry is read back whole and containers are read side by side.

Two inputs are served: real files (``pack_files``, ``read_entries``) and the
catalog of frame files (``frame_index``, ``shared_frames``, ``layout``), whose
entries are spans of a stream's frames.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.paths import camera_key, resolve_path
from kinelake.session import cut

INDEX = "container string, path string, offset long, length long, checksum string"
BATCH_BYTES = 64 << 20  # of contents that a task holds at once


def container_of(df: DataFrame, size: str, target: int, order: list[str], lanes: int | None = None) -> DataFrame:
    """Adds ``container`` (lane, number) and ``offset`` so that containers hold about ``target`` bytes.

    Rows are spread over ``lanes`` by a hash of ``order`` and laid one after the
    other in each lane; a container takes the entries that begin within its
    share of the lane, so that it exceeds ``target`` by less than one entry.
    Null and negative sizes count as 0. By default there is a lane for every
    100,000 rows or 256 containers, so that lanes stay alike at any size.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    if lanes is None:
        rows, total = df.agg(F.count(F.lit(1)), F.sum(n)).first()
        lanes = max(1, rows // 100_000, int(total or 0) // (256 * target))
    laned = df.withColumn("_lane", F.pmod(F.xxhash64(*order), F.lit(lanes)).cast("int")).withColumn("_n", n)
    lane = W.partitionBy("_lane").orderBy(*order)
    begun = laned.withColumn("_begin", F.sum("_n").over(lane.rowsBetween(W.unboundedPreceding, -1)))
    begun = begun.withColumn("_begin", F.coalesce("_begin", F.lit(0)))
    placed = begun.withColumn("_no", F.floor(F.col("_begin") / target))
    first = W.partitionBy("_lane", "_no")
    return (
        placed.withColumn("offset", F.col("_begin") - F.min("_begin").over(first))
        .withColumn("container", F.format_string("c%05d-%06d", "_lane", "_no"))
        .drop("_lane", "_n", "_begin", "_no")
    )


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, given as path or URI, and the folder's path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def pack_files(files: DataFrame, out_dir: str, target: int = 128 << 20, lanes: int | None = None) -> DataFrame:
    """Write (path, content) rows into containers under ``out_dir``; returns the index.

    A hash of the path says into which of ``lanes`` a file goes, by default as
    many as the bytes are targets, so the bytes are moved once; a task writes
    its lane in order of paths and begins a new container whenever one has
    ``target`` bytes, so that a container exceeds it by less than one entry.
    ``out_dir`` is a folder or URI that all executors reach. Null content is
    packed as no bytes and a null path is left out; a repeated path with the
    same bytes is packed once, with other bytes it raises. A container is
    written under a temporary name and renamed, so a task that runs again
    leaves the same files.
    """
    spark = files.sparkSession
    if lanes is None:
        total = files.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
        lanes = max(1, -(-int(total) // target))
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    lane = F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int")
    ready = files.filter("path is not null").select(lane.alias("lane"), "path", F.coalesce("content", F.lit(b"")).alias("content"))
    ready = ready.repartition(lanes, "lane").sortWithinPartitions("lane", "path")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = store(out_dir)
        disk.create_dir(base, recursive=True)
        out, name, tmp, at, lane_now, number = None, "", "", 0, None, 0
        last: tuple[str, str] | None = None

        def close() -> None:
            if out is not None:
                out.close()
                disk.move(tmp, f"{base}/{name}")

        for batch in batches:
            rows: list[tuple] = []
            for lane_, path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = content.as_buffer()
                digest = hashlib.sha256(raw).hexdigest()
                if last is not None and last[0] == path:
                    if last[1] != digest:
                        raise ValueError(f"different files under {path}")
                    continue
                last = (path, digest)
                if out is None or lane_ != lane_now or at >= target:
                    close()
                    number = 0 if lane_ != lane_now else number + 1
                    lane_now, at = lane_, 0
                    name = f"c{lane_:06d}-{number:04d}"
                    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
                    out = disk.open_output_stream(tmp)
                out.write(raw)
                rows.append((name, path, at, raw.size, digest))
                at += raw.size
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], [c.split()[0] for c in INDEX.split(", ")])
        close()

    return ready.mapInArrow(write, INDEX)


def read_entries(index: DataFrame, out_dir: str, tasks: int | None = None) -> DataFrame:
    """(path, content) of the entries of an index; a checksum that differs raises.

    Entries go to tasks by container and come in order of offset, so that a
    task opens each of its containers once; what is put out at once is bounded
    in bytes.
    """
    wanted = index.select(*[c.split()[0] for c in INDEX.split(", ")])
    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = store(out_dir)
        name, source = None, None
        for batch in batches:
            paths, contents, held = [], [], 0
            for container, path, offset, length, checksum in zip(*(c.to_pylist() for c in batch.columns)):
                if container != name:
                    if source is not None:
                        source.close()
                    name, source = container, disk.open_input_file(f"{base}/{container}")
                raw = source.read_at(length, offset)
                if hashlib.sha256(raw).hexdigest() != checksum:
                    raise ValueError(f"{path}: the bytes in {container} differ from the index")
                paths.append(path)
                contents.append(raw)
                held += length
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    paths, contents, held = [], [], 0
            if paths:
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
        if source is not None:
            source.close()

    return wanted.repartition(tasks, "container").sortWithinPartitions("container", "offset").mapInArrow(read, "path string, content binary")


def write_manifest(index: DataFrame, out_dir: str) -> dict:
    """Write the index beside its containers and, last, a manifest with their numbers; returns the manifest.

    A folder without manifest is not finished. An older manifest goes first.
    """
    spark = index.sparkSession
    disk, base = store(out_dir)
    disk.create_dir(base, recursive=True)
    if disk.get_file_info(f"{base}/manifest.json").type != fs.FileType.NotFound:
        disk.delete_file(f"{base}/manifest.json")
    where = out_dir if "://" in out_dir else f"file://{base}"
    index.write.mode("overwrite").parquet(f"{where}/index")
    row = spark.read.parquet(f"{where}/index").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("container").alias("containers"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    told = row.asDict()
    with disk.open_output_stream(f"{base}/.manifest.json") as out:
        out.write(json.dumps(told).encode())
    disk.move(f"{base}/.manifest.json", f"{base}/manifest.json")
    return told


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """The index of a finished folder; one without manifest, or whose index or containers have other numbers, raises."""
    disk, base = store(out_dir)
    if disk.get_file_info(f"{base}/manifest.json").type == fs.FileType.NotFound:
        raise ValueError(f"{out_dir} is not finished")
    with disk.open_input_file(f"{base}/manifest.json") as source:
        told = json.loads(source.read())
    index = spark.read.parquet(f"{out_dir if '://' in out_dir else f'file://{base}'}/index")
    ends = {r["container"]: r["size"] for r in index.groupBy("container").agg(F.sum("length").alias("size")).toLocalIterator()}
    real = {i.base_name: i.size for i in disk.get_file_info(fs.FileSelector(base)) if i.is_file}
    if len(ends) != told["containers"] or sum(ends.values()) != told["bytes"] or any(real.get(k) != v for k, v in ends.items()):
        raise ValueError(f"{out_dir} holds other containers than its manifest tells")
    return index


# frame files of a catalog


def frame_index(cache_files: DataFrame) -> DataFrame:
    """One entry per file: stream (path, trajectory, camera), span of frames, bytes, checksum.

    A file repeated under its id counts once; null or non-positive num_frames,
    a null first_frame, path that leads nowhere, trajectory or camera gives a
    null span: such files hold no frame and share none.
    """
    path = resolve_path(F.col("path"), F.col("dataset_name"))
    cam = camera_key(F.col("video_key"))
    whole = path.isNotNull() & cam.isNotNull() & F.col("trajectory_id").isNotNull() & (F.col("num_frames") > 0)
    return (
        cache_files.filter("file_id is not null")
        .groupBy("file_id")
        .agg(*[F.min(c).alias(c) for c in ("path", "dataset_name", "video_key", "trajectory_id", "first_frame", "num_frames", "n_bytes", "digest")])
        .select(
            "file_id",
            path.alias("stream_path"),
            "trajectory_id",
            cam.alias("camera"),
            F.when(whole, F.col("first_frame")).alias("lo"),
            F.when(whole, F.col("first_frame") + F.col("num_frames") - 1).alias("hi"),
            "n_bytes",
            "digest",
        )
    )


STREAM = ["stream_path", "trajectory_id", "camera"]


def shared_frames(index: DataFrame) -> DataFrame:
    """(file_id_a, file_id_b), a < b, of entries of a stream that share a frame.

    Lookup by nodes of a dyadic index over frame numbers: an entry lies on the
    one or two nodes of the level that fits its length, and asks the nodes above
    it at those coarser levels that any entry has (at most 63). Nodes split a
    stream of any size; only pairs that share a frame come out, each at the one
    node that has the later of both first frames.
    """
    entries = cut(index.filter("lo is not null and hi >= lo").select(*STREAM, "file_id", "lo", "hi").withColumn("level", F.ceil(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")))
    levels = sorted(r[0] for r in entries.select("level").distinct().collect())  # at most 63 numbers

    def node(frame, level):
        return F.expr(f"shiftright({frame}, {level})")

    host = entries.withColumn("node", F.explode(F.array_distinct(F.array(node("lo", "level"), node("hi", "level")))))
    level_list = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    probe = (
        entries.withColumnRenamed("level", "own")
        .withColumn("level", F.explode(F.filter(level_list, lambda x: x >= F.col("own"))))
        .withColumn("node", F.explode(F.array_distinct(F.array(node("lo", "level"), node("hi", "level")))))
    )
    a, b = probe.alias("a"), host.alias("b")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*STREAM, "level", "node"]]
    meet = a.join(b, [*keys, F.expr("a.file_id <> b.file_id and a.lo <= b.hi and b.lo <= a.hi and (a.own < b.level or a.file_id < b.file_id) and a.node = shiftright(greatest(a.lo, b.lo), a.level)")])
    return meet.select(F.least("a.file_id", "b.file_id").alias("file_id_a"), F.greatest("a.file_id", "b.file_id").alias("file_id_b"))


def layout(index: DataFrame, target: int = 64 << 20, lanes: int | None = None) -> DataFrame:
    """The container layout in which every frame of every stream is found once.

    Within a stream in order of (lo, hi desc, file_id) an entry has the frames
    that no entry before it has; entries left without frames are not packed.
    Payloads are packed whole, so that ``length`` and ``checksum`` are those of
    the original and verify it: ``skip`` tells how many of its leading frames
    are those of an entry before it. Unknown lengths take no room. A stream is
    swept in blocks of 2^16 frames, each with what the blocks before it hold, so
    that no stream is one task.
    """
    span = cut(index.filter("lo is not null and hi >= lo").withColumn("_block", F.shiftright("lo", 16)))
    earlier = W.partitionBy(*STREAM).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = span.groupBy(*STREAM, "_block").agg(F.max("hi").alias("_hi")).withColumn("_carry", F.max("_hi").over(earlier)).drop("_hi")
    before = W.partitionBy(*STREAM, "_block").orderBy("lo", F.desc("hi"), "file_id").rowsBetween(W.unboundedPreceding, -1)
    kept = (
        span.join(carry, [*STREAM, "_block"])
        .withColumn("_seen", F.greatest(F.max("hi").over(before), "_carry"))
        .withColumn("frame_from", F.greatest("lo", F.coalesce(F.col("_seen") + 1, "lo")))
        .filter("frame_from <= hi")
        .withColumnRenamed("n_bytes", "length")
    )
    placed = container_of(cut(kept), "length", target, [*STREAM, "frame_from", "file_id"], lanes)
    return placed.select("container", *STREAM, "frame_from", F.col("hi").alias("frame_to"), (F.col("frame_from") - F.col("lo")).alias("skip"), "file_id", "offset", "length", F.col("digest").alias("checksum"))

"""Readers of episode formats that need a library of their own, and their relational parts.

Each ``*_rows`` function turns one file into rows and is run over a table of
paths by :func:`read_files`, one task per group of files. A library that is
not there raises with its name when the format is used, not before. What does
not need the library (instructions, derived actions, filters, resampling) is
DataFrame code that works on rows from anywhere.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.joins import asof, overlap
from kinelake.operators.space import zeros
from kinelake.operators.temporal import grid

ROWS = "path string, frame bigint, name string, value array<float>"


def need(module: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"this format needs the library {module!r}, which is not installed") from e


def list_files(spark: SparkSession, root: str, pattern: str, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of files by glob, at most ``depth`` folders deep, in order of path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "modificationTime")
    if depth is not None:
        below = F.size(F.split(F.regexp_replace("path", "^" + root.rstrip("/") + "/", ""), "/")) - 1
        raw = raw.filter(below <= depth)
    return raw.orderBy("path").limit(limit) if limit is not None else raw


def read_files(files: DataFrame, rows_of: Callable[[str], Iterable[tuple]], schema: str = ROWS, per_task: int = 16) -> DataFrame:
    """Rows of every file of a (path) table, by a reader of one file."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path in pdf["path"]:
                rows = list(rows_of(path))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    n = max(1, files.count() // per_task)
    return files.select("path").repartition(n, "path").mapInPandas(run, schema)


def hdf5_rows(names: dict[str, str]) -> Callable[[str], Iterator[tuple]]:
    """Datasets (T, D) of an HDF5 file by the names they shall have; missing ones have no rows."""

    def rows(path: str) -> Iterator[tuple]:
        h5 = need("h5py")
        with h5.File(path, "r") as f:
            for inner, name in names.items():
                if inner in f:
                    a = np.asarray(f[inner], np.float32)
                    a = a.reshape(len(a), -1)
                    yield from ((path, i, name, a[i].tolist()) for i in range(len(a)))

    return rows


def zarr_rows(names: dict[str, str]) -> Callable[[str], Iterator[tuple]]:
    def rows(path: str) -> Iterator[tuple]:
        store = need("zarr").open(path, mode="r")
        for inner, name in names.items():
            a = np.asarray(store[inner], np.float32)
            yield from ((path, i, name, a[i].ravel().tolist()) for i in range(len(a)))

    return rows


def mcap_rows(topics: Iterable[str], field: str = "position") -> Callable[[str], Iterator[tuple]]:
    """Messages of topics as (path, log time in ns, topic, numbers of their ``field``)."""
    from kinelake.sources.mcap import Recording

    def rows(path: str) -> Iterator[tuple]:
        for topic, at, fields in Recording(path).messages(topics):
            yield path, at, topic, [float(x) for x in np.ravel(fields.get(field) or [])]

    return rows


def lance_rows(columns: list[str]) -> Callable[[str], Iterator[tuple]]:
    def rows(path: str) -> Iterator[tuple]:
        for batch in need("lance").dataset(path).to_batches(columns=columns):
            for i, row in enumerate(batch.to_pylist()):
                yield from ((path, i, c, np.ravel(row[c]).tolist()) for c in columns)

    return rows


def video_rows(indices: Callable[[str], list[int]] | None = None, decode: Callable[[str], Iterable[bytes]] | None = None) -> Callable[[str], Iterator[tuple]]:
    """Frames of a video as (path, frame, 'frame', pixels); the codec is a hook, PyAV by default."""

    def rows(path: str) -> Iterator[tuple]:
        wanted = None if indices is None else set(indices(path))
        if decode is None:
            av = need("av")
            with av.open(path) as box:
                pictures = (f.to_ndarray(format="rgb24").tobytes() for f in box.decode(video=0))
                yield from ((path, i, "frame", list(np.frombuffer(p, np.uint8).astype(float))) for i, p in enumerate(pictures) if wanted is None or i in wanted)
        else:
            yield from ((path, i, "frame", list(np.frombuffer(p, np.uint8).astype(float))) for i, p in enumerate(decode(path)) if wanted is None or i in wanted)

    return rows


# the relational parts


def grouped(rows: DataFrame, parts: list[tuple[str, int]], name: str) -> DataFrame:
    """(path, frame, name): vectors of several named parts in order; a missing part is zeros of its width."""
    by = rows.groupBy("path", "frame").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_m"))
    cells = [F.coalesce(F.try_element_at("_m", F.lit(p)), zeros(w)) for p, w in parts]
    return by.select("path", "frame", F.concat(*cells).alias(name))


def next_targets(rows: DataFrame, state: str, grips: list[tuple[int, str]], dim: int) -> DataFrame:
    """``action``: the next state (the last repeats) with gripper dims taken from (dim, column) pairs."""
    w = W.partitionBy("path").orderBy("frame")
    target = F.slice(F.coalesce(F.lead(state).over(w), F.col(state)), 1, dim)
    at = F.create_map(*[x for d, c in grips for x in (F.lit(d), F.col(c).cast("float"))])
    return rows.withColumn("action", F.transform(target, lambda x, i: F.coalesce(F.try_element_at(at, i), x)))


def with_constant_grip(left: str, right: str, grip: float = 0.5):
    """Two poses with a constant gripper value after each."""
    return F.concat(F.col(left), F.array(F.lit(grip).cast("float")), F.col(right), F.array(F.lit(grip).cast("float")))


def resampled(events: DataFrame, fps: float, topics: list[tuple[str, int]]) -> DataFrame:
    """(path, frame, tick, vector): topics on one grid over the time they all cover, each by its last message.

    Times are bigint nanoseconds. Episodes in which a topic is missing have no
    grid.
    """
    names = [t for t, _ in topics]
    events = events.filter(F.col("topic").isin(names))
    full = events.groupBy("path").agg(F.count_distinct("topic").alias("_k")).filter(F.col("_k") == len(names)).select("path")
    span = overlap(events.join(full, "path", "left_semi"), ["path"], "topic", "ts_ns")
    ticks = grid(span, round(1e9 / fps)).select("path", "tick")
    each = ticks.withColumn("topic", F.explode(F.array(*[F.lit(t) for t in names])))
    met = asof(each, events, ["path", "topic"], "tick", "ts_ns", ["value"])
    by = met.groupBy("path", "tick").agg(F.map_from_entries(F.collect_list(F.struct("topic", "value"))).alias("_m"))
    whole = by.select("path", "tick", F.concat(*[F.element_at("_m", F.lit(t)) for t in names]).alias("vector"))
    return whole.withColumn("frame", F.row_number().over(W.partitionBy("path").orderBy("tick")).cast("long") - 1)


def listed_episodes(meta: DataFrame, files: DataFrame) -> DataFrame:
    """Episodes named by a list of relative paths that exist; paths that leave their folder are dropped."""
    clean = meta.filter(~F.col("episode").rlike(r"(^/|(^|/)\.\.(/|$))")).withColumn("path", F.concat_ws("/", F.regexp_replace("root", "/+$", ""), "episode"))
    return clean.join(files.select("path"), "path", "left_semi")


def subtasks(labels: DataFrame, digests: DataFrame) -> DataFrame:
    """(episode, start, stop, text) of annotation files; a digest other than at the scan raises."""
    met = labels.join(digests.withColumnRenamed("digest", "_told"), "source", "left")
    same = F.when(F.col("digest").eqNullSafe(F.col("_told")), F.col("actions")).otherwise(F.raise_error(F.concat(F.col("source"), F.lit(" has changed since the scan"))).cast(labels.schema["actions"].dataType))
    return met.withColumn("a", F.explode(same)).select("episode", F.col("a.start_frame").alias("start"), F.col("a.end_frame").alias("stop"), F.col("a.action_text").alias("text"))


# synthetic episodes


def synthetic(spark: SparkSession, episodes: int, length: int, state_dim: int, action_dim: int, seed: int = 0) -> DataFrame:
    """(episode, frame, state, action) of made-up smooth episodes, the same for a seed."""
    base = spark.range(episodes * length).select((F.col("id") / length).cast("long").alias("episode"), (F.col("id") % length).alias("frame"))
    wave = lambda dims, salt: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.sin(F.col("frame") / 10.0 + i + (F.xxhash64(F.lit(seed + salt), "episode") % 100) / 10.0).cast("float"))
    return base.withColumn("state", wave(state_dim, 0)).withColumn("action", wave(action_dim, 1))

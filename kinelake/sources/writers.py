"""Sinks: repo trees, the episode index, and truncated or annotated conversions."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.joins import intern
from kinelake.operators.temporal import sample_index
from kinelake.sources.lerobot import DATA_V2, existing
from kinelake.spec import DumpSpec

CHUNK = 1000


def _write_json(path: str, value) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w") as file:
        json.dump(value, file, allow_nan=False)
    os.replace(path + ".tmp", path)


def _write_lines(df: DataFrame, path: str) -> None:
    """JSON lines of a metadata table in one file, streamed partition by partition through the driver."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".tmp", "w") as file:
        for row in df.toJSON().toLocalIterator():
            file.write(row + "\n")
    os.replace(path + ".tmp", path)


def write_repo(frames: DataFrame, dest: str, spec: DumpSpec, version: str = "v2.1") -> None:
    """Frames (episode, frame, state, action, task) as a v2.1 repo under ``dest``.

    Tasks are numbered in the order of their first step, ``index`` runs over all
    steps in order of episode. Each episode's file is written in a task of its
    own; ``meta/info.json`` comes last and makes the repo count.
    """
    info = os.path.join(dest, "meta", "info.json")
    if os.path.exists(info):
        os.unlink(info)
    first = frames.groupBy("task").agg(F.min(F.struct("episode", "frame")).alias("_f"))
    ordered = sample_index(first.select("task", "_f.*").withColumn("_one", F.lit(1).cast("long")), ["episode", "frame"], "_one").select("task", F.col("start").alias("task_index"))
    sizes = frames.groupBy("episode").agg(F.count(F.lit(1)).alias("length"), F.min_by("task", "frame").alias("task"))
    placed = sample_index(sizes, ["episode"], "length").select("episode", "length", F.col("start").alias("_base"), F.col("task").alias("_first"))
    rows = frames.join(placed, "episode").join(ordered, "task").select(
        F.col("episode").alias("episode_index"), F.col("frame").alias("frame_index"), (F.col("frame") / float(spec.fps)).alias("timestamp"), (F.col("_base") + F.col("frame")).alias("index"), "task_index",
        F.col("state").cast("array<float>").alias("state"), F.col("action").cast("array<float>").alias("action"),
    )
    own = {"state": spec.state_columns[0], "action": spec.action_columns[0]}  # names with dots stay out of plans

    def put(parts):
        import pyarrow as pa
        import pyarrow.parquet as pq

        from kinelake.operators.spikes import whole_groups

        for t in whole_groups(parts, ["episode_index"]):
            t = t.rename_columns([own.get(c, c) for c in t.column_names])
            ids = t.column("episode_index").to_numpy()
            for e in sorted(set(ids.tolist())):
                path = os.path.join(dest, DATA_V2.format(episode_chunk=e // CHUNK, episode_index=e))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                pq.write_table(t.filter(pa.array(ids == e)), path + ".tmp")
                os.replace(path + ".tmp", path)
                yield pa.record_batch([pa.array([e], pa.int64())], ["episode_index"])

    done = rows.repartition("episode_index").sortWithinPartitions("episode_index", "frame_index").mapInArrow(put, "episode_index long").count()
    meta = placed.select(F.col("episode").alias("episode_index"), F.array("_first").alias("tasks"), "length").orderBy("episode_index")
    _write_lines(meta, os.path.join(dest, "meta", "episodes.jsonl"))
    _write_lines(ordered.select("task_index", "task").orderBy("task_index"), os.path.join(dest, "meta", "tasks.jsonl"))
    vector = lambda n: {"dtype": "float32", "shape": [n], "names": None}
    _write_json(info, {
        "codebase_version": version, "fps": spec.fps, "robot_type": spec.embodiment, "chunks_size": CHUNK, "data_path": DATA_V2, "total_episodes": done,
        "features": {spec.state_columns[0]: vector(spec.state_dim), spec.action_columns[0]: vector(spec.action_dim)},
    })


def convert(frames: DataFrame, episodes: DataFrame, dest: str, spec: DumpSpec) -> None:
    """Any dump's frames (repo, episode_index, frame, state, action) as a v2.1 repo under ``dest``.

    ``episodes`` (path or repo, maybe episode_index, lang) gives the texts;
    episodes are numbered in order of repo and index, those without a text get
    an empty one. A repo that is there is left as it is (``ready`` tells).
    """
    keys = ["repo", "episode_index"]
    named = episodes.withColumnRenamed("path", "_path")
    named = named if "repo" in named.columns else named.withColumn("repo", F.col("_path"))
    by = [k for k in keys if k in named.columns]
    told = named.groupBy(*by).agg(F.min("lang").alias("task"))
    order = frames.select(*keys).distinct().withColumn("_one", F.lit(1).cast("long"))
    numbers = sample_index(order, keys, "_one").select(*keys, F.col("start").alias("episode"))
    rows = frames.join(numbers, keys).join(told, by, "left")
    write_repo(rows.select("episode", "frame", "state", "action", F.coalesce("task", F.lit("")).alias("task")), dest, spec)


def ready(dest: str) -> bool:
    """Whether a conversion to ``dest`` is finished: its info comes last."""
    return os.path.exists(os.path.join(dest, "meta", "info.json"))


# episode index


def save_index(records: DataFrame, path: str, spec: DumpSpec, root: str) -> None:
    """Records with their repos interned, and a manifest that is written last; an empty scan raises."""
    manifest = os.path.join(path, "manifest.json")
    if os.path.exists(manifest):
        os.unlink(manifest)
    totals = records.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest("n_frames", F.lit(0))).alias("steps")).first()
    if not totals["n"]:
        raise ValueError("an empty scan is not saved")
    rows, dim = intern(records, "repo", "repo_index")
    rows.write.mode("overwrite").parquet(os.path.join(path, "episodes"))
    dim.write.mode("overwrite").parquet(os.path.join(path, "repos"))
    _write_json(manifest, {"spec": spec.name, "revision": spec.revision, "root": os.path.abspath(root), "n_records": totals["n"], "n_steps": totals["steps"]})


def load_index(spark: SparkSession, path: str, spec: DumpSpec, root: str) -> DataFrame | None:
    """Saved records; None without an index; one that is incomplete or of another scan raises."""
    if not os.path.isdir(path):
        return None
    manifest = os.path.join(path, "manifest.json")
    if not os.path.exists(manifest):
        raise ValueError(f"{path} is incomplete")
    with open(manifest) as file:
        told = json.load(file)
    for key, want in (("spec", spec.name), ("revision", spec.revision), ("root", os.path.abspath(root))):
        if told.get(key) != want:
            raise ValueError(f"{path}: {key} is {told.get(key)!r}, not {want!r}")
    rows = spark.read.parquet(os.path.join(path, "episodes")).join(spark.read.parquet(os.path.join(path, "repos")), "repo_index").drop("repo_index")
    if rows.count() != told["n_records"]:
        raise ValueError(f"{path}: other records than the manifest tells")
    ends = rows.agg(F.min("path"), F.max("path")).first()
    gone = sorted(set(ends) - set(existing(spark, list(set(ends)))))
    if gone:
        raise ValueError(f"{path}: {gone[0]} is gone since the scan")
    return rows


def scanned(spark: SparkSession, root: str, spec: DumpSpec, scan, index: str | None = None, max_episodes: int | None = None, rescan: bool = False) -> DataFrame:
    """Records from the index or a scan; only whole scans are saved."""
    if index and not rescan and (rows := load_index(spark, index, spec, root)) is not None:
        return rows.orderBy("path").limit(max_episodes) if max_episodes is not None else rows
    rows = scan(spark, root, spec, max_episodes)
    if index and max_episodes is None:
        save_index(rows, index, spec, root)
    return rows


# conversions


def shortest(state: Column, action: Column) -> tuple[Column, Column]:
    """Two (T, D) arrays cut to the shorter one."""
    n = F.least(F.size(state), F.size(action))
    return F.slice(state, 1, n), F.slice(action, 1, n)


def slim_pose(vector: Column) -> tuple[Column, Column]:
    """Pose (first seven dims, filled with zeros) and the value after it (zero without)."""
    pose = F.slice(F.concat(vector, F.array_repeat(F.lit(0).cast("float"), 7)), 1, 7)
    return pose, F.coalesce(F.get(vector, F.lit(7)), F.lit(0).cast("float"))


def ready_kind(names: set[str]) -> str | None:
    """What layout a folder has, by the relative names in it."""
    has = lambda end: any(n.endswith(end) for n in names)
    if has("meta/info.json"):
        return "lerobot"
    if has("proprio_stats.h5"):
        return "agibot"
    if has("das_gripper_slim_meta.json") or has("episode.hdf5"):
        return "das"
    if any(".zarr/" in n or n.endswith(".zarr") for n in names):
        return "zarr"
    if any(".lance/" in n or n.endswith(".lance") for n in names):
        return "lance"
    if has(".mcap"):
        return "mcap"
    if has(".npz"):
        return "numpy"
    return None


def latest_of(frames: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in order."""
    return frames.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("_r = 1").drop("_r")


def drop_cache(path: str) -> None:
    """Remove a cache, its manifest first, so that a half-removed one never looks whole."""
    manifest = os.path.join(path, "manifest.json")
    if os.path.exists(manifest):
        os.unlink(manifest)
    shutil.rmtree(path, ignore_errors=True)

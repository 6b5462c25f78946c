"""Readers of the dumps that are no LeRobot repos, as ``episodes`` and ``frames`` of their registered sources.

``episodes``: (path, n_frames, lang and what the dump tells of it), one row per
episode with frames. ``frames``: (repo, episode_index, frame, n, state, action)
with ``repo`` the episode's file; actions that a dump does not have are null
(``api.Dataset.complete`` derives them). Files are listed by Spark, which skips
names that begin with a dot, and read in tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import joins, space
from kinelake.sources import formats, mcap
from kinelake.sources.formats import need
from kinelake.spec import REGISTRY, Registry


def below(root: str, path: Column) -> Column:
    return F.regexp_replace(path, "^\\Q" + root.rstrip("/") + "\\E/", "")


def part(path: Column, from_end: int) -> Column:
    """A folder's name, counted from the file's own (1)."""
    return F.element_at(F.split(path, "/"), -from_end)


def text_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of small text files by glob; none where there are none."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("content").cast("string").alias("content"))


def cells(rows: DataFrame, master: str) -> DataFrame:
    """(path, frame, _m): the named values of each frame that ``master`` has."""
    by = rows.groupBy("path", "frame").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_m"))
    return by.filter(F.map_contains_key("_m", F.lit(master)))


def joined(parts: list[tuple[str, int]]) -> Column:
    """Named values one after the other; a missing one is zeros of its width."""
    return F.concat(*[F.coalesce(F.try_element_at("_m", F.lit(p)), space.zeros(w)) for p, w in parts])


def as_frames(rows: DataFrame, state: Column, action: Column | None, spec, episodes: DataFrame) -> DataFrame:
    kind = "array<float>"
    sized = rows.select("path", "frame", space.fit_dim(state.cast(kind), spec.state_dim).alias("state"), (space.fit_dim(action.cast(kind), spec.action_dim) if action is not None else F.lit(None).cast(kind)).alias("action"))
    met = sized.join(episodes.select("path", F.col("n_frames").alias("n")), "path")
    return met.select(F.col("path").alias("repo"), F.lit(0).cast("long").alias("episode_index"), "frame", "n", "state", "action")


def counted(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Files with ``n_frames``; those without frames drop out."""
    return files.join(rows.groupBy("path").agg((F.max("frame") + 1).alias("n_frames")), "path")


def sizes_of(files: DataFrame, size) -> DataFrame:
    """(path, n_frames) told by a reader of one file's head; files without frames drop out."""
    return formats.read_files(files, lambda path: [(path, int(size(path)))], "path string, n_frames bigint").filter("n_frames > 0")


def hdf5_length(name: str):
    """Rows of a dataset from a file's head: no value is read; a missing dataset has none."""

    def size(path: str) -> int:
        with need("h5py").File(path, "r") as f:
            return f[name].shape[0] if name in f else 0

    return size


# AgiBot: HDF5 by task and episode, instructions per episode

AGIBOT_JOINTS = "state/joint/position"
AGIBOT_STATE = [(AGIBOT_JOINTS, 14), ("state/effector/position", 2), ("state/head/position", 2), ("state/waist/position", 2)]
AGIBOT_ACTION = [("action/joint/position", 14), ("action/effector/position", 2), ("action/head/position", 2), ("action/waist/position", 2), ("action/robot/velocity", 2)]


def agibot_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of ``[<base>/]proprio_stats/<task>/<episode>/*.h5`` with their instruction and video folder."""
    files = formats.list_files(spark, root, "*.h5").select("path").filter(below(root, F.col("path")).rlike(r"^([^/]+/)?proprio_stats/[^/]+/[^/]+/[^/]+$"))
    sized = sizes_of(files, hdf5_length(AGIBOT_JOINTS))
    base = F.regexp_replace("path", "/proprio_stats/.*$", "")
    task, episode = part(F.col("path"), 3), part(F.col("path"), 2)
    rows = sized.withColumn("base", base).withColumn("task_id", task).withColumn("episode_id", episode.cast("long").cast("string")).withColumn("task", F.concat_ws("\x1f", "base", "task_id"))
    row = "array<struct<episode_id:string,english:string,instruction:string,task:string,task_name:string>>"
    told = text_files(spark, root, "task_*.json").filter(F.col("path").contains("/task_info/")).withColumn("list", F.trim("content").startswith("["))
    told = told.select(F.concat_ws("\x1f", F.regexp_replace("path", "/task_info/[^/]*$", ""), F.regexp_extract("path", r"task_([^/]*)\.json$", 1)).alias("task"), "path", "list", F.explode(F.from_json("content", row)).alias("r"))
    nameless = F.col("r.episode_id").isNull() & F.col("list")
    number = F.when(nameless, F.raise_error(F.concat(F.col("path"), F.lit(": an annotation has no episode_id"))).cast("string")).otherwise(F.coalesce(F.col("r.episode_id").cast("long").cast("string"), F.lit("*")))
    texts = [F.nullif(F.trim(f"r.{k}"), F.lit("")) for k in ("english", "instruction", "task", "task_name")]
    told = told.select("task", number.alias("episode_id"), F.coalesce(*texts, F.lit("")).alias("lang"))
    out = joins.instruction(rows, told, "task", "episode_id", "lang")
    return out.select("path", "n_frames", "lang", "task_id", "episode_id", F.concat("base", F.lit("/observations/"), "task_id", F.lit("/"), part(F.col("path"), 2), F.lit("/videos")).alias("video_dir"), F.concat_ws(":", F.lit("agibot"), "task_id", "episode_id").alias("parent_id"))


def agibot_frames(spark: SparkSession, root: str) -> DataFrame:
    episodes = agibot_episodes(spark, root)
    names = {p: p for p, _ in (*AGIBOT_STATE, *AGIBOT_ACTION)}
    rows = cells(formats.read_files(episodes.select("path"), formats.hdf5_rows(names)), AGIBOT_JOINTS)
    return as_frames(rows, joined(AGIBOT_STATE), joined(AGIBOT_ACTION), REGISTRY.get("agibot").spec, episodes)


# DAS: HDF5 named by a list of the task, wrist videos beside it

DAS_META, DAS_FILE, DAS_LEFT, DAS_RIGHT = "das_gripper_slim_meta.json", "episode.hdf5", "cam_left_wrist.mp4", "cam_right_wrist.mp4"
DAS_POSE = "observations/left_eef_pose"
DAS_STATE = [(DAS_POSE, 7), ("observations/mag_left", 1), ("observations/right_eef_pose", 7), ("observations/mag_right", 1)]


def das_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episodes that the tasks' lists name, or all below a root without lists; those without a left wrist video drop out."""
    metas = text_files(spark, root, DAS_META).filter(F.size(F.split(below(root, F.col("path")), "/")) <= 2)
    named = metas.select(F.regexp_replace("path", "/[^/]*$", "").alias("root"), F.explode(F.from_json(F.get_json_object("content", "$.episodes"), "array<string>")).alias("episode"))
    named = named.select("root", F.regexp_replace(F.replace("episode", F.lit("\\"), F.lit("/")), "^/+", "").alias("episode")).filter(F.col("episode").endswith(DAS_FILE))
    files = formats.list_files(spark, root, DAS_FILE).select("path")
    if not metas.isEmpty():
        files = formats.listed_episodes(named, files).select("path").distinct()
    folder = F.regexp_replace("path", "/[^/]*$", "")
    videos = formats.list_files(spark, root, "cam_*_wrist.mp4").select(folder.alias("folder"), part(F.col("path"), 1).alias("video"))
    videos = videos.groupBy("folder").agg(F.bool_or(F.col("video") == DAS_LEFT).alias("left"), F.bool_or(F.col("video") == DAS_RIGHT).alias("right")).filter("left")
    kept = files.withColumn("folder", folder).join(videos, "folder")
    sized = kept.join(sizes_of(kept.select("path"), hdf5_length(DAS_POSE)), "path")
    shown = F.map_filter(F.create_map(F.lit("cam_left_wrist"), F.concat("folder", F.lit(f"/{DAS_LEFT}")), F.lit("cam_right_wrist"), F.when(F.col("right"), F.concat("folder", F.lit(f"/{DAS_RIGHT}")))), lambda k, v: v.isNotNull())
    return sized.select("path", "n_frames", F.replace(part(F.col("path"), 4), F.lit("_"), F.lit(" ")).alias("lang"), shown.alias("videos"))


def das_frames(spark: SparkSession, root: str) -> DataFrame:
    episodes = das_episodes(spark, root)
    rows = cells(formats.read_files(episodes.select("path"), formats.hdf5_rows({p: p for p, _ in DAS_STATE})), DAS_POSE)
    return as_frames(rows, joined(DAS_STATE), None, REGISTRY.get("das_gripper").spec, episodes)


# EgoVerse: zarr stores, grippers unknown

EGO_LEFT, EGO_RIGHT = "left.obs_ee_pose", "right.obs_ee_pose"


def ego_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Zarr stores at most two folders deep; frames as their attributes tell, else as the pose array has."""
    heads = text_files(spark, root, "zarr.json").unionByName(text_files(spark, root, ".zarray"))
    inner = heads.select(F.regexp_extract("path", r"^(.*?\.zarr)/", 1).alias("store"), F.regexp_replace("path", r"^.*?\.zarr/", "").alias("inner"), "content")
    listed = formats.list_files(spark, root, "*").select(F.regexp_extract("path", r"^(.*?\.zarr)/", 1).alias("store")).filter("store <> ''").distinct()
    head = inner.filter("inner = 'zarr.json'").select("store", "content")
    said = lambda k: F.nullif(F.trim(F.get_json_object("content", k)), F.lit(""))
    known = listed.join(head, "store", "left").filter(F.size(F.split(below(root, F.col("store")), "/")) <= 2)
    known = known.select(F.col("store").alias("path"), F.coalesce(*map(said, ("$.attributes.task_description", "$.attributes.task_name", "$.task_description", "$.task_name")), F.lit("")).alias("lang"), F.expr("try_cast(get_json_object(content, '$.attributes.total_frames') as bigint)").alias("_n"))
    unknown = known.filter("coalesce(_n, 0) <= 0").select("path")

    def size(path: str) -> int:
        try:
            return need("zarr").open(path, mode="r")[EGO_LEFT].shape[0]
        except (KeyError, FileNotFoundError):
            return 0

    counted_ = sizes_of(unknown, size) if not unknown.isEmpty() else spark.createDataFrame([], "path string, n_frames bigint")
    return known.join(counted_, "path", "left").select("path", F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("n_frames")).alias("n_frames"), "lang").filter("n_frames > 0")


def ego_frames(spark: SparkSession, root: str) -> DataFrame:
    episodes = ego_episodes(spark, root)
    rows = cells(formats.read_files(episodes.select("path"), formats.zarr_rows({EGO_LEFT: EGO_LEFT, EGO_RIGHT: EGO_RIGHT})), EGO_LEFT)
    rows = rows.select("path", "frame", F.try_element_at("_m", F.lit(EGO_LEFT)).alias("l"), F.coalesce(F.try_element_at("_m", F.lit(EGO_RIGHT)), space.zeros(7)).alias("r"))
    return as_frames(rows, formats.with_constant_grip("l", "r"), None, REGISTRY.get("egoverse").spec, episodes)


# Hy: row ranges of Lance tables


def hy_episodes(spark: SparkSession, root: str) -> DataFrame:
    """(path, episode_index, start, n_frames, lang) of ``table_*`` folders, by their list or by their episodes' parquet; no list is one episode of one row."""
    folder = lambda c: F.regexp_extract(c, r"^(.*?/table_[^/]*)/", 1)
    files = formats.list_files(spark, root, "*").select("path").filter(below(os.path.dirname(root.rstrip("/")) if os.path.basename(root.rstrip("/")).startswith("table_") else root, F.col("path")).startswith("table_"))
    tables = files.filter(F.col("path").contains(".lance/")).select(folder("path").alias("table")).distinct()
    listed = text_files(spark, root, "hy_episodes.jsonl").select(folder("path").alias("table"), F.explode(F.from_json(F.get_json_object("content", "$.episodes"), "array<array<bigint>>")).alias("e"))
    listed = listed.select("table", F.get("e", F.lit(0)).alias("episode_index"), F.get("e", F.lit(1)).alias("start"), F.get("e", F.lit(2)).alias("n_frames"), F.coalesce(F.get("e", F.lit(3)), F.lit(0).cast("long")).alias("task_index"))
    out = listed
    paths = [r[0] for r in files.filter(F.col("path").rlike(r"/meta/episodes/.*\.parquet$")).collect()]  # metadata files of the dump
    if paths:
        raw = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn("table", folder(F.regexp_replace(F.input_file_name(), "^file:/+", "/")))
        col = lambda *names: F.coalesce(*[F.col(n).cast("long") for n in names if n in raw.columns], F.lit(None).cast("long"))
        start = F.coalesce(col("dataset_from_index", "from_index"), F.lit(0))
        packed = raw.select("table", F.coalesce(col("episode_index"), F.lit(0)).alias("episode_index"), start.alias("start"), F.coalesce(col("length"), col("dataset_to_index") - start).alias("n_frames"), F.coalesce(col("task_index"), F.lit(0)).alias("task_index")).filter("n_frames > 0")
        out = out.unionByName(packed.join(listed.select("table").distinct(), "table", "left_anti"))
    lone = tables.join(out.select("table").distinct(), "table", "left_anti").select("table", *[F.lit(v).cast("long").alias(c) for c, v in (("episode_index", 0), ("start", 0), ("n_frames", 1), ("task_index", 0))])
    out = out.unionByName(lone).join(tables, "table", "left_semi")
    said = [r[0] for r in files.filter(F.col("path").endswith("/meta/tasks.parquet")).collect()]
    told = None
    for path in said:
        t = spark.read.parquet(path)
        text = next((c for c in ("task_en", "task") if c in t.columns), None)
        if text:
            one = t.select(F.lit(path.removesuffix("/meta/tasks.parquet")).alias("table"), (F.col("task_index") if "task_index" in t.columns else F.monotonically_increasing_id()).cast("long").alias("task_index"), F.col(text).alias("lang"))
            told = one if told is None else told.unionByName(one)
    out = out.join(told, ["table", "task_index"], "left") if told is not None else out.withColumn("lang", F.lit(None).cast("string"))
    return out.select(F.concat("table", F.lit("/"), part(F.col("table"), 1), F.lit(".lance")).alias("path"), "episode_index", "start", "n_frames", F.coalesce("lang", F.lit("")).alias("lang"))


def hy_frames(spark: SparkSession, root: str) -> DataFrame:
    """States and actions of each episode's own rows; an action of two numbers is the grippers, its poses are the next state's."""
    spec = REGISTRY.get("hy_lance").spec

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lance = need("lance")
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                taken = lance.dataset(r.path).take(np.arange(r.start, r.start + r.n_frames), columns=["observation_state", "action"])
                state, action = (taken[c].to_pylist() for c in ("observation_state", "action"))
                yield pd.DataFrame({"repo": r.path, "episode_index": r.episode_index, "frame": np.arange(len(state)), "n": r.n_frames, "state": state, "_a": [np.ravel(a).tolist() for a in action]})

    raw = hy_episodes(spark, root).select("path", "episode_index", "start", "n_frames").repartition("path", "episode_index")
    rows = raw.mapInPandas(read, "repo string, episode_index bigint, frame bigint, n bigint, state array<float>, _a array<float>")
    rows = rows.withColumn("state", space.fit_dim(F.col("state"), spec.state_dim)).withColumn("path", F.concat_ws("#", "repo", F.col("episode_index").cast("string")))
    rows = rows.withColumn("_l", F.get("_a", F.lit(0))).withColumn("_r", F.get("_a", F.lit(1)))
    spliced = formats.next_targets(rows, "state", [(7, "_l"), (15, "_r")], spec.action_dim)
    action = F.when(F.size("_a") == 2, F.col("action")).otherwise(space.fit_dim(F.col("_a"), spec.action_dim))
    return spliced.select("repo", "episode_index", "frame", "n", "state", action.alias("action"))


# ABC: MCAP recordings

# The topics of arms and cameras.
ABC_STATE = [("/left-arm-state", 6), ("/left-ee-state", 1), ("/right-arm-state", 6), ("/right-ee-state", 1)]
ABC_ACTION = [("/left-arm-action", 6), ("/left-ee-action", 1), ("/right-arm-action", 6), ("/right-ee-action", 1)]
ABC_CAMERAS = {"cam_high": ("/top-left-camera", "/top-right-camera", "/top-camera"), "cam_left_wrist": ("/left-wrist-camera",), "cam_right_wrist": ("/right-wrist-camera",)}


def abc_episodes(spark: SparkSession, root: str) -> DataFrame:
    """``episode.mcap`` files with the frames of the grid that all topics cover, told by their message indexes; those with one or none drop out."""
    fps, names = REGISTRY.get("abc").spec.fps, [t for t, _ in (*ABC_STATE, *ABC_ACTION)]
    inner = below(root, F.col("path"))
    files = formats.list_files(spark, root, "episode.mcap").select("path")
    data = files.filter(inner.startswith("data/"))
    files = data if not data.isEmpty() else files

    def size(path: str) -> int:
        t0, t1 = mcap.overlap(path, names)
        return (t1 - t0) // round(1e9 / fps) + 1

    return sizes_of(files, size).filter("n_frames > 1").select("path", "n_frames", F.replace(part(F.col("path"), 3), F.lit("_"), F.lit(" ")).alias("lang"))


def abc_frames(spark: SparkSession, root: str) -> DataFrame:
    spec, topics = REGISTRY.get("abc").spec, [*ABC_STATE, *ABC_ACTION]
    episodes = abc_episodes(spark, root)
    events = formats.read_files(episodes.select("path"), formats.mcap_rows([t for t, _ in topics]), "path string, ts_ns bigint, topic string, value array<float>")
    widths = F.create_map(*[F.lit(x) for t in topics for x in t])
    # each topic at its width, so that one vector holds all at fixed places
    wide = F.slice(F.concat("value", F.array_repeat(F.lit(0.0).cast("float"), 6)), F.lit(1), F.element_at(widths, F.col("topic")))
    grid = formats.resampled(events.withColumn("value", wide), spec.fps, topics)
    cutoff = sum(w for _, w in ABC_STATE)
    return as_frames(grid, F.slice("vector", 1, cutoff), F.slice("vector", cutoff + 1, cutoff), spec, episodes)


def abc_images(episodes: DataFrame, camera: str, fps: float = 10.0) -> DataFrame:
    """(path, frame, ts_ns, format, packet): of each grid step the camera's last packet before it, the first one at the start.

    The first topic of the camera that a file has is taken; the grid begins at
    its first packet.
    """
    topics = ABC_CAMERAS[camera]

    def rows(path: str) -> Iterator[tuple]:
        found = mcap.Recording(path)
        have = {t for t in found.topics(topics).values()}
        topic = next((t for t in topics if t in have), None)
        if topic is not None:
            for _, at, fields in found.messages([topic]):
                yield path, at, str(fields.get("format") or "h264").lower(), bytes(fields.get("data") or b"")

    packets = formats.read_files(episodes.select("path"), rows, "path string, ts_ns bigint, format string, packet binary")
    began = packets.groupBy("path").agg(F.min("ts_ns").alias("_t0"))
    ticks = episodes.select("path", "n_frames").join(began, "path").select("path", "_t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)).alias("frame"))
    ticks = ticks.select("path", "frame", (F.col("_t0") + F.col("frame") * F.lit(round(1e9 / fps))).alias("tick"))
    return joins.asof(ticks, packets, ["path"], "tick", "ts_ns", ["ts_ns", "format", "packet"], strict=True).drop("tick")


ADAPTERS = {"agibot": (agibot_episodes, agibot_frames), "das_gripper": (das_episodes, das_frames), "egoverse": (ego_episodes, ego_frames), "hy_lance": (hy_episodes, hy_frames), "abc": (abc_episodes, abc_frames)}


def attach(registry: Registry) -> None:
    """Give the registered sources of these dumps their readers, where they have none."""
    for name, (episodes, frames) in ADAPTERS.items():
        source = registry.sources.get(name)
        if source is not None and source.frames is None:
            source.episodes, source.frames = episodes, frames


attach(REGISTRY)

"""Dumps of ``meta/info.json`` repos in the v2 and v3 layouts, read by Spark.

Metadata of all repos under a root is read in a handful of distributed scans;
nothing walks episodes on the driver. Frames are parquet scans with column
pruning, and a choice of files and episodes that reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.space import pack
from kinelake.spec import DumpSpec

MAX_DEPTH = 5
DATA_V2 = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
DATA_V3 = "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"
INFO = "codebase_version string, fps string, data_path string, video_path string, chunks_size long, robot_type string"


def _relative(path: Column, root: str) -> Column:
    """Path below the root, whatever scheme the listing puts before it."""
    return F.regexp_replace(path, "^.*?" + re.escape(root.rstrip("/")) + "/", "")


def repos(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(repo, version, fps, info, ...) of the repos under ``root``.

    A repo is a folder with ``meta/info.json`` at most ``max_depth`` below the
    root; repos inside a repo and hidden folders are passed over. A version
    other than v2 or v3 or a missing fps raises.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "info.json").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    found = raw.select(path.alias("path"), F.col("content").cast("string").alias("info")).filter(F.col("path").endswith("/meta/info.json"))
    found = found.withColumn("repo", F.regexp_replace("path", "/meta/info\\.json$", ""))
    rel = _relative(F.concat("repo", F.lit("/")), root)
    found = found.withColumn("_depth", F.size(F.filter(F.split(rel, "/"), lambda p: p != ""))).filter((F.col("_depth") <= max_depth) & ~rel.rlike("(^|/)[._]"))
    outer = found.select(F.concat("repo", F.lit("/")).alias("_outer"))
    # a repo's parents are looked up by equality, one row per ancestor
    ups = found.withColumn("_ups", F.transform(F.sequence(F.lit(1), F.greatest("_depth", F.lit(1))), lambda i: F.concat(F.array_join(F.slice(F.split("repo", "/"), 1, F.size(F.split("repo", "/")) - i), "/"), F.lit("/"))))
    inside = ups.select("repo", F.explode("_ups").alias("_outer")).join(outer, "_outer", "left_semi").select("repo").distinct()
    kept = found.join(inside, "repo", "left_anti").withColumn("_i", F.from_json("info", INFO))
    told = F.col("_i.codebase_version")
    fps = F.expr("try_cast(_i.fps as double)")
    return kept.select(
        "repo",
        F.when(told.startswith("v2"), "v2").when(told.startswith("v3"), "v3").otherwise(F.raise_error(F.concat(F.lit("unknown version of "), "repo")).cast("string")).alias("version"),
        F.when(fps > 0, fps).otherwise(F.raise_error(F.concat(F.lit("no fps in "), "repo")).cast("double")).alias("fps"),
        F.coalesce("_i.data_path", F.when(told.startswith("v3"), DATA_V3).otherwise(DATA_V2)).alias("data_path"),
        F.col("_i.video_path").alias("video_path"),
        F.coalesce("_i.chunks_size", F.lit(1000)).alias("chunks_size"),
        "info",
    )


def filled(template: Column, **numbers: Column) -> Column:
    """A path template with ``{name:03d}`` places filled; other places stay."""
    out = template
    for name, value in numbers.items():
        for digits in range(1, 10):
            out = F.replace(out, F.lit(f"{{{name}:0{digits}d}}"), F.lpad(value.cast("string"), digits, "0"))
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lines of all files of a name under ``meta/``, with their repo."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return raw.select(F.regexp_replace(path, f"/meta/{re.escape(name)}$", "").alias("repo"), F.col("value")).filter(F.col("repo") != path)


FEW = 10_000  # files whose names are given to a scan; more are found below their repos


def data_counts(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(repo, parquet, episode_index, n): rows per data file and episode, of files or of all below folders."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").schema("episode_index long").parquet(*folders)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    at = raw.select(path.alias("p"), "episode_index").filter(F.col("p").rlike("/data/chunk-[0-9]+/"))
    return at.groupBy(F.regexp_extract("p", "^(.*)/data/chunk-[^/]*/[^/]*$", 1).alias("repo"), F.regexp_extract("p", "(data/chunk-[^/]*/[^/]*)$", 1).alias("parquet"), "episode_index").agg(F.count(F.lit(1)).alias("n"))


def scan_v2(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Episode records of v2 repos, from ``episodes.jsonl`` or else their data files.

    A length that is missing or not positive is counted in the file; episodes
    that stay without frames are dropped.
    """
    v2 = known.filter("version = 'v2'")
    lines = _texts(spark, root, "episodes.jsonl").withColumn("j", F.from_json("value", "episode_index long, tasks array<string>, length long"))
    listed = v2.join(lines.select("repo", "j.*"), "repo").filter("episode_index is not null")
    chunk = F.floor(F.col("episode_index") / F.col("chunks_size"))
    listed = listed.withColumn("chunk", chunk).withColumn("parquet", filled(F.col("data_path"), episode_chunk=F.col("chunk"), episode_index=F.col("episode_index")))
    cols = ["repo", "episode_index", "tasks", "chunk", "parquet", "n"]
    out = listed.filter("length > 0").withColumn("n", F.col("length")).select(*cols)
    # files are opened only where a length is missing or a repo has no list
    unsized = listed.filter("coalesce(length, 0) <= 0")
    files = unsized.select(F.concat_ws("/", "repo", "parquet").alias("p")).distinct().limit(FEW + 1).collect()
    if files:
        there = existing(spark, [r.p for r in files]) if len(files) <= FEW else [f"{r.repo}/data" for r in unsized.select("repo").distinct().collect()]
        if there:
            counted = data_counts(spark, there).groupBy("repo", "parquet").agg(F.sum("n").alias("n"))
            out = out.unionByName(unsized.join(counted, ["repo", "parquet"]).select(*cols))
    lone = existing(spark, [f"{r.repo}/data" for r in v2.join(lines.select("repo").distinct(), "repo", "left_anti").select("repo").collect()])  # a row per repo
    if lone:
        rest = data_counts(spark, lone)
        out = out.unionByName(rest.select("repo", "episode_index", F.lit(None).cast("array<string>").alias("tasks"), F.regexp_extract("parquet", "chunk-0*([0-9]+)/", 1).cast("long").alias("chunk"), "parquet", "n"))
    return out.withColumnRenamed("n", "n_frames").withColumn("task_index", F.lit(None).cast("long"))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are there."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    return [p for p in paths if (h := fs.Path(p)).getFileSystem(conf).exists(h)]


def scan_v3(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """Episode records of v3 repos from ``meta/episodes``, or else counted in the packed files.

    ``cameras`` maps a video key to chunk, file and the second where the
    episode begins in it.
    """
    v3 = known.filter("version = 'v3'")
    cols = ["repo", "episode_index", "tasks", "chunk", "parquet", "n_frames", "cameras", "task_index"]
    camera = "map<string,struct<chunk:bigint,file_index:bigint,from_timestamp:double>>"
    metas = [r.repo for r in v3.select("repo").collect()]  # one row per repo
    out = None
    seen = [p.removesuffix("/meta/episodes") for p in existing(spark, [f"{r}/meta/episodes" for r in metas])]
    if seen:
        raw = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*[f"{r}/meta/episodes" for r in seen])
        kinds = dict(raw.dtypes)
        keys = sorted({m[1] for c in raw.columns if (m := re.fullmatch(r"videos/(.+)/(?:chunk_index|file_index|from_timestamp)", c))})
        cell = lambda k, f, t: F.col(f"`videos/{k}/{f}`").cast(t) if f"videos/{k}/{f}" in kinds else F.lit(None).cast(t)
        entries = [F.struct(F.lit(k).alias("key"), F.struct(cell(k, "chunk_index", "long").alias("chunk"), cell(k, "file_index", "long").alias("file_index"), F.coalesce(cell(k, "from_timestamp", "double"), F.lit(0.0)).alias("from_timestamp")).alias("value")) for k in keys]
        cams = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["file_index"].isNotNull())) if keys else F.create_map().cast(camera)
        number = F.col("task_index").cast("long") if "task_index" in kinds else F.lit(None).cast("long")
        tasks = F.flatten("tasks") if kinds.get("tasks", "").startswith("array<array") else F.array("tasks") if kinds.get("tasks") == "string" else F.col("tasks") if "tasks" in kinds else F.lit(None).cast("array<string>")
        repo = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), "/meta/episodes/.*$", "")
        rows = raw.select(repo.alias("repo"), "episode_index", F.col("length").cast("long").alias("n_frames"), tasks.alias("tasks"), F.col("`data/chunk_index`").cast("long").alias("chunk"), F.col("`data/file_index`").cast("long").alias("file"), cams.cast(camera).alias("cameras"), number.alias("task_index"))
        rows = rows.join(v3.select("repo", "data_path"), "repo").filter("n_frames > 0")
        out = rows.withColumn("parquet", filled(F.col("data_path"), chunk_index=F.col("chunk"), file_index=F.col("file"), episode_chunk=F.col("chunk"), episode_index=F.col("file"))).select(*cols)
    others = existing(spark, [f"{r}/data" for r in metas if r not in seen])
    if others:
        rest = data_counts(spark, others).select("repo", "episode_index", F.lit(None).cast("array<string>").alias("tasks"), F.regexp_extract("parquet", "chunk-0*([0-9]+)/", 1).cast("long").alias("chunk"), "parquet", F.col("n").alias("n_frames"), F.create_map().cast(camera).alias("cameras"), F.lit(None).cast("long").alias("task_index"))
        out = rest if out is None else out.unionByName(rest)
    return out if out is not None else spark.createDataFrame([], f"repo string, episode_index long, tasks array<string>, chunk long, parquet string, n_frames long, cameras {camera}, task_index long")


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """(repo, task_index, task) from ``meta/tasks.jsonl``, or ``meta/tasks.parquet`` where there is none.

    A number told twice takes the first text in order. A parquet file without
    ``task`` has its texts in its last column, one without ``task_index`` is
    numbered as its rows come.
    """
    rows = _texts(spark, root, "tasks.jsonl").select("repo", F.from_json("value", "task_index long, task string").alias("j")).select("repo", "j.*")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "tasks.parquet").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    paths = [r.path for r in listed.filter(F.col("path").endswith("/meta/tasks.parquet")).collect()]  # at most one per repo
    if paths:

        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for path, content in zip(pdf["path"], pdf["content"]):
                    t = pq.read_table(pa.BufferReader(content)).to_pandas().reset_index()
                    t = t.drop(columns=[c for c in t.columns if c == "index"])
                    text = "task" if "task" in t.columns else next(c for c in reversed(t.columns) if c != "task_index")
                    number = t["task_index"] if "task_index" in t.columns else range(len(t))
                    yield pd.DataFrame({"repo": path.removesuffix("/meta/tasks.parquet"), "task_index": [int(i) for i in number], "task": [str(x) for x in t[text]]})

        raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        packed = raw.mapInPandas(read, "repo string, task_index long, task string")
        rows = rows.unionByName(packed.join(rows.select("repo").distinct(), "repo", "left_anti"))
    return rows.filter("task_index is not null").groupBy("repo", "task_index").agg(F.min("task").alias("task"))


def scan(spark: SparkSession, root: str, spec: DumpSpec | None = None, max_episodes: int | None = None) -> DataFrame:
    """Episode records of all repos under ``root``: (kind, path, repo, version, fps, episode_index, ..., lang).

    ``lang`` is the first task of the episode, else the task of its number, else
    the repo's first task, else empty. ``max_episodes`` limits the records in order of path and episode.
    """
    known = repos(spark, root)
    v2 = scan_v2(spark, root, known).withColumn("cameras", F.create_map().cast("map<string,struct<chunk:bigint,file_index:bigint,from_timestamp:double>>"))
    both = v2.unionByName(scan_v3(spark, root, known))
    told = tasks(spark, root)
    first = told.groupBy("repo").agg(F.min_by("task", "task_index").alias("_first"))
    rows = both.join(known.select("repo", "version", "fps", "video_path"), "repo").join(first, "repo", "left")
    rows = rows.join(told.withColumnRenamed("task", "_own"), ["repo", "task_index"], "left")
    rows = rows.select(
        F.lit("lerobot").alias("kind"), F.concat_ws("/", "repo", "parquet").alias("path"), "repo", "version", "fps", "episode_index", "chunk", "parquet", "n_frames", "cameras", "video_path",
        F.coalesce(F.try_element_at("tasks", F.lit(1)), "_own", "_first", F.lit("")).alias("lang"),
    )
    if max_episodes is not None:
        rows = rows.orderBy("repo", "episode_index").limit(max_episodes)
    return rows


def video_frames(from_timestamp: Column, fps: Column, index: Column) -> Column:
    """Frame numbers in a packed video: half-even round of the begin, and on."""
    return F.rint(F.coalesce(from_timestamp, F.lit(0.0)) * fps).cast("long") + index


def feature_type(info: Column, camera: str) -> Column:
    """Declared type of a camera, by its full name or its own."""
    return F.coalesce(F.get_json_object(info, f"$.features['observation.images.{camera}'].dtype"), F.get_json_object(info, f"$.features['{camera}'].dtype"))


def read_frames(spark: SparkSession, records: DataFrame, spec: DumpSpec, root: str) -> DataFrame:
    """(repo, episode_index, frame, timestamp, task_index, state, action) of the records' steps.

    Of up to ``FEW`` files only these are read, and row groups without a wanted
    episode are passed over; more are read below their repos. Columns are pruned
    to what the spec names. A missing column raises with the names there are, vectors of
    several columns must make up the spec's width. Without action columns
    ``action`` is null.
    """
    files = [r.path for r in records.select("path").distinct().limit(FEW + 1).collect()]
    if len(files) > FEW:
        files = [f"{r.repo}/data" for r in records.select("repo").distinct().collect()]  # a row per repo
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("mergeSchema", "true").parquet(*files)
    ends = records.agg(F.min("episode_index"), F.max("episode_index")).first()
    raw = raw.filter(F.col("episode_index").between(*ends))
    kinds = dict(raw.dtypes)

    def vector(columns: tuple[str, ...], dim: int, need: bool) -> Column:
        missing = [c for c in columns if c not in kinds]
        if missing and not need and len(missing) == len(columns):
            return F.lit(None).cast("array<float>")
        if missing:
            raise ValueError(f"columns {missing} are not among {sorted(kinds)}")
        scalars = {i for i, c in enumerate(columns) if not kinds[c].startswith("array")}
        return pack([F.col(f"`{c}`") for c in columns], scalars, dim)

    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    extra = [F.col(c) if c in kinds else F.lit(None).cast(t).alias(c) for c, t in (("timestamp", "double"), ("task_index", "long"))]
    rows = raw.select(path.alias("path"), "episode_index", F.col("frame_index").cast("long").alias("frame"), *extra, vector(spec.state_columns, spec.state_dim, True).alias("state"), vector(spec.action_columns, spec.action_dim, False).alias("action"))
    return rows.join(records.select("path", "repo", "episode_index", "n_frames"), ["path", "episode_index"])


def image_bytes(column: str, kind: str) -> Column:
    """Bytes of an image column that holds them plainly or in a struct."""
    return F.col(f"{column}.bytes") if kind.startswith("struct") else F.col(column)


def is_image(kind: str) -> bool:
    return kind == "binary" or bool(re.match(r"struct<.*\bbytes:binary", kind))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns a trajectory cache keeps: numbers and lists of numbers, no images."""
    number = r"(tinyint|smallint|int|bigint|float|double|boolean)"
    return [c for c, k in df.dtypes if re.fullmatch(rf"{number}|array<{number}>", k)]


def require_counts(payloads: DataFrame, keys: list[str], records: DataFrame, n: str = "n_frames") -> DataFrame:
    """(keys, frames) of image streams; one that is not as long as its record tells raises."""
    got = payloads.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"))
    met = got.join(records.select(*keys, F.col(n).alias("_n")), keys, "left")
    wrong = F.raise_error(F.concat(F.lit("stream of "), F.col("frames").cast("string"), F.lit(" frames, told "), F.coalesce(F.col("_n").cast("string"), F.lit("none")))).cast("long")
    return met.withColumn("frames", F.when(F.col("frames").eqNullSafe(F.col("_n")), F.col("frames")).otherwise(wrong)).drop("_n")

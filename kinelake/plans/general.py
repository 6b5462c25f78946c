"""Queries of the core's operators on measurements and small files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import archive, spikes
from kinelake.session import scratch, table


def bounds_of(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    """Limits by (spec, vector) and the gripper dimensions; both tables are fixed dictionaries (24 and 202 rows)."""
    rows = (
        table(spark, sf_dir, "specs").select("name", "embodiment", "state_dim", "action_dim")
        .join(table(spark, sf_dir, "joint_limits"), "embodiment")
        .select("name", "vector", "dim", "joint_kind", "lo", "hi", "state_dim", "action_dim")
        .distinct()
        .collect()
    )
    bounds: dict = {}
    held: dict = {}
    for name, vector, dim, kind, lo, hi, ds, da in rows:
        width = ds if vector == "state" else da
        if dim >= width:
            continue
        low, high = bounds.setdefault((name, vector), (np.full(width, -np.inf), np.full(width, np.inf)))
        low[dim], high[dim] = (-np.inf if lo is None else lo), (np.inf if hi is None else hi)
        if kind == "gripper":
            held.setdefault((name, vector), set()).add(dim)
    return bounds, held


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds, held = bounds_of(spark, sf_dir)
    return spikes.find_spikes(table(spark, sf_dir, "frames"), bounds, held)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.shared_frames(archive.frame_index(table(spark, sf_dir, "cache_files")))


def p5_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.layout(archive.frame_index(table(spark, sf_dir, "cache_files")))


def p5_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a small file: packed into containers, read back and held against the original, by source."""
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("/documents/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    folder = scratch(spark)
    archive.write_manifest(archive.pack_files(docs, folder, 8 << 20), folder)
    back = archive.read_entries(archive.read_manifest(spark, folder), folder)
    told = docs.select("source", "path", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("a"))
    both = told.join(back.select("path", F.sha2("content", 256).alias("b")), "path", "left")
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"), F.count_if(F.col("a") == F.col("b")).alias("same"))


def p2_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of p2_found that the embodiment cannot reach, which SQL can tell, too."""
    specs = table(spark, sf_dir, "specs").select(F.col("name").alias("dataset_name"), "embodiment").distinct()
    limits = specs.join(table(spark, sf_dir, "joint_limits"), "embodiment").select("dataset_name", "vector", "dim", F.col("lo").cast("float").alias("lo"), F.col("hi").cast("float").alias("hi")).distinct()
    frames = table(spark, sf_dir, "frames").select("frame_id", "dataset_name", "state", "action")
    cells = None
    for v in ("state", "action"):
        one = frames.select("frame_id", "dataset_name", F.lit(v).alias("vector"), F.posexplode(v).alias("dim", "value"))
        cells = one if cells is None else cells.unionByName(one)
    found = p2_found(spark, sf_dir).join(cells, ["frame_id", "vector", "dim"]).join(limits, ["dataset_name", "vector", "dim"])
    return found.filter("not isnan(value) and (value < lo or value > hi)").select("frame_id", "vector", "dim").distinct()


def p5_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that the layout holds by camera, and how many it holds more than once (none)."""
    frames = p5_layout(spark, sf_dir).select(*archive.STREAM, F.explode(F.sequence("frame_from", "frame_to")).alias("frame"))
    by = frames.groupBy(*archive.STREAM, "frame").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("camera").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("n") > 1).alias("twice"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_layout": p5_layout, "p5_packed": p5_packed, "p2_outside": p2_outside, "p5_covered": p5_covered}

def resolved_sql(path: str, dataset: str) -> str:
    """SQL of the place a path leads to; parent folders are taken back up to four times."""
    text = f"trim({path}, ' ' || chr(9) || chr(10) || chr(13))"
    plain = f"case when lower(substr({text}, 1, 5)) = 'file:' then url_decode(regexp_replace(substr({text}, 6), '^//[^/]*', '')) else {text} end"
    slashed = f"replace({plain}, chr(92), '/')"
    base = f"'/lake/datasets/' || regexp_extract(regexp_replace(trim({dataset}), '[/]+$', ''), '([^/]*)$', 1) || '/'"
    out = f"regexp_replace(regexp_replace(case when {slashed} like '/%' then {slashed} else {base} || {slashed} end, '/([.]?/)+', '/', 'g'), '(.)/[.]?$', '\\1')"
    for _ in range(4):
        out = f"regexp_replace({out}, '/[^/]+/[.][.](/|$)', '\\1')"
    return out


SQL: dict[str, str] = {
    "p2_outside": """with s as (select distinct name, embodiment from specs), l as (select distinct s.name, j.vector, j.dim, cast(j.lo as float) as lo, cast(j.hi as float) as hi from s join joint_limits j on j.embodiment = s.embodiment),
      c as (select frame_id, dataset_name, 'state' as vector, cast(unnest(generate_series(0, len(state) - 1)) as integer) as dim, unnest(state) as value from frames where state is not null and len(state) > 0 and frame_id is not null
        union all select frame_id, dataset_name, 'action', cast(unnest(generate_series(0, len(action) - 1)) as integer), unnest(action) from frames where action is not null and len(action) > 0 and frame_id is not null)
      select distinct c.frame_id, c.vector, c.dim from c join l on l.name = c.dataset_name and l.vector = c.vector and l.dim = c.dim where c.value is not null and not isnan(c.value) and (c.value < l.lo or c.value > l.hi)""",
    "p5_covered": f"""with f as (select file_id, {resolved_sql("min(path)", "min(dataset_name)")} as p, min(trajectory_id) as t, regexp_replace(trim(min(video_key)), '^(observation[.]images[.]|images?[.])', '') as c, min(first_frame) as lo, min(first_frame) + min(num_frames) - 1 as hi
      from cache_files group by file_id having min(num_frames) > 0), x as (select distinct p, t, c, unnest(generate_series(lo, hi)) as frame from f where p is not null and t is not null and c is not null and c <> '' and lo is not null)
    select c as camera, count(*) as frames, cast(0 as bigint) as twice from x group by 1""",
    "p5_packed": "select source, count(*) as files, cast(sum(coalesce(octet_length(encode(text)), 0)) as bigint) as bytes, count(*) as same from documents group by source",
    "p5_found": f"""with f as (select file_id, {resolved_sql("min(path)", "min(dataset_name)")} as p, min(trajectory_id) as t, regexp_replace(trim(min(video_key)), '^(observation[.]images[.]|images?[.])', '') as c, min(first_frame) as lo, min(first_frame) + min(num_frames) - 1 as hi
      from cache_files group by file_id having min(num_frames) > 0)
    select a.file_id as file_id_a, b.file_id as file_id_b from f a join f b on a.p = b.p and a.t = b.t and a.c = b.c and a.file_id < b.file_id and a.lo <= b.hi and b.lo <= a.hi""",
}

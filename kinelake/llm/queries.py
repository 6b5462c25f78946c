"""Queries of the operators for training data, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.paths import camera_key, dataset_key, resolve_path
from kinelake.llm import components, drift, lineage, mixing, nearest, packing, quantiles, reading, tokens
from kinelake.plans.general import resolved_sql
from kinelake.session import cut, table

CAPACITY = 2048
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


WANTED = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each dimension of each dataset's state and action."""
    frames = quantiles.once(table(spark, sf_dir, "frames"), "frame_id", ["dataset_name"], ["state", "action"])
    return quantiles.percentiles(quantiles.sketches(frames, ["dataset_name"], ["state", "action"], "weight"), WANTED)


def p1_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per day, from sketches that also add up to those of all days."""
    frames = table(spark, sf_dir, "frames").withColumn("day", F.to_date("logged_at"))
    keys = ["dataset_name", "day"]
    return quantiles.percentiles(quantiles.sketches(quantiles.once(frames, "frame_id", keys, ["state", "action"]), keys, ["state", "action"], "weight"), WANTED)


def p1_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all days from the sketches of single days."""
    frames = table(spark, sf_dir, "frames").withColumn("day", F.to_date("logged_at"))
    keys = ["dataset_name", "day"]
    days = quantiles.sketches(quantiles.once(frames, "frame_id", keys, ["state", "action"]), keys, ["state", "action"], "weight")
    return quantiles.percentiles(quantiles.merge(days, ["dataset_name", "vector", "dim"]), WANTED)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with the name of their dataset, taken from the path where it is missing."""
    named = dataset_key(F.col("dataset_name"))
    from_path = F.nullif(F.regexp_extract(resolve_path(F.col("path")), "^/lake/datasets/([^/]+)/", 1), F.lit(""))
    return table(spark, sf_dir, "episodes").select("record_id", F.coalesce(named, from_path).alias("dataset_name"), "n_frames")


def p3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame ranges of episodes by shard and slot of the mix."""
    catalog = table(spark, sf_dir, "catalog_entries").select("name", "weight", "max_repeats")
    known = _sized(spark, sf_dir).join(catalog.select(F.col("name").alias("dataset_name")).distinct(), "dataset_name", "left_semi")
    return mixing.mix(known, catalog, "dataset_name", "record_id", "n_frames").withColumnsRenamed({"source": "dataset_name", "record": "record_id"})


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the catalog's entries."""
    catalog = table(spark, sf_dir, "catalog_entries").select("name", "weight", "max_repeats")
    seen = mixing.sized(_sized(spark, sf_dir), "dataset_name", "record_id", "n_frames").groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("frames"))
    return mixing.shares(p3_mix(spark, sf_dir).withColumnRenamed("dataset_name", "source"), catalog, seen)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "schema_files")).select("file_id", "column_name", "change_kind")


def p7_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw rows in one table with a typed column per field."""
    return drift.rows_of(table(spark, sf_dir, "schema_files"))


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of all raw rows under the first names of their fields, a row each."""
    return drift.table_of(table(spark, sf_dir, "schema_files"))


def _fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo_index, fps) of every dump: its own, else the one in info, which may be text."""
    told = F.expr("try_cast(trim(get_json_object(info, '$.fps')) as double)")
    return table(spark, sf_dir, "repos").filter("repo_index is not null").groupBy("repo_index").agg(F.max("fps").alias("fps"), F.max(told).alias("told")).select("repo_index", F.coalesce("fps", "told").alias("fps")).filter("fps > 0")


def p4_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Steps and images of every camera with their times in the episode and half the frame period."""
    ep = ["repo_index", "episode_index"]
    half = _fps(spark, sf_dir).select("repo_index", (F.lit(0.5) / F.col("fps") + 1e-9).alias("tol"))
    cams = "map<string,struct<video_key:string,from_timestamp:string>>"
    starts = (
        table(spark, sf_dir, "episodes")
        .filter("videos_json is not null and repo_index is not null and episode_index is not null")
        .select(*ep, F.explode(F.from_json("videos_json", cams)).alias("cam", "v"))
        .select(*ep, camera_key(F.col("cam")).alias("camera"), F.expr("try_cast(trim(v.from_timestamp) as double)").alias("begin"))
        .groupBy(*ep, "camera")
        .agg(F.max("begin").alias("begin"))
    )
    images = (
        table(spark, sf_dir, "camera_images")
        .select("image_id", *ep, camera_key(F.col("video_key")).alias("camera"), "packed_ts")
        .dropna()
        .groupBy("image_id")
        .agg(*[F.min(c).alias(c) for c in (*ep, "camera", "packed_ts")])
        .join(starts, [*ep, "camera"], "left")
        .withColumn("t", F.col("packed_ts") - F.coalesce("begin", F.lit(0.0)))
        .join(half, "repo_index")
        .select("image_id", *ep, "camera", "t", "tol")
    )
    images = cut(images)
    frames = table(spark, sf_dir, "frames").select("frame_id", *ep, F.col("step_ts").alias("t")).dropna().groupBy("frame_id").agg(*[F.min(c).alias(c) for c in (*ep, "t")])
    steps = frames.join(images.select(*ep, "camera", "tol").distinct(), ep)
    return steps, images


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps, images = p4_sides(spark, sf_dir)
    return nearest.nearest(steps, images, ["repo_index", "episode_index", "camera"], "frame_id", "image_id").select("frame_id", "image_id")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.components(lineage.keys(table(spark, sf_dir, "episodes")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def p6_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "episodes").select("record_id", dataset_key(F.col("dataset_name")).alias("dataset"))
    return components.split(records, _groups(spark, sf_dir), SHARES, label="dataset")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by split and their share of all."""
    by = p6_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("group_id").alias("groups"))
    return by.withColumn("share", F.round(F.col("records") / F.sum("records").over(W.partitionBy()), 6))  # one row per split


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(tokens.spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.count(tokens.spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return packing.pack(cut(sizes), CAPACITY)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, sf_dir), CAPACITY)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, language and level, with their mean probabilities."""
    where = table(spark, sf_dir, "documents").select("doc_id", "source", F.lower(F.trim("lang")).alias("lang"))
    by = _levels(spark, sf_dir).join(where, "doc_id").groupBy("source", "lang", "reading_level")
    return by.agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), *[F.round(F.avg(f"p{k}"), 6).alias(f"p{k}") for k in range(1, 5)])


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite readings behind each percentile, repeated frames once."""
    return p1_percentiles(spark, sf_dir).select("dataset_name", "vector", F.col("dim").cast("long").alias("dim"), "n")


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the split, and groups torn apart (none)."""
    by = p6_split(spark, sf_dir).groupBy("group_id").agg(F.count_distinct("record_id").alias("k"), F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    return by.agg(F.sum("k").alias("records"), F.sum("n").alias("rows"), F.count_if(F.col("splits") > 1).alias("torn"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers, containers beyond their capacity (none), and documents split though they fit (none)."""
    p = p9_containers(spark, sf_dir)
    docs = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    docs = docs.select(F.lit(1).alias("documents"), ((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).cast("int").alias("split"), F.lit(0).alias("overfull"))
    boxes = p.groupBy("container").agg(F.sum("n_tokens").alias("n")).select(F.lit(0).alias("documents"), F.lit(0).alias("split"), (F.col("n") > CAPACITY).cast("int").alias("overfull"))
    return docs.unionByName(boxes).agg(*[F.sum(c).alias(c) for c in ("documents", "split", "overfull")])


QUERIES = {"p1_counts": p1_counts, "p6_kept": p6_kept, "p9_kept": p9_kept, "p1_percentiles": p1_percentiles, "p1_days": p1_days, "p1_days_combined": p1_days_combined, "p3_mix": p3_mix, "p3_shares": p3_shares, "p7_found": p7_found, "p7_table": p7_table, "p7_values": p7_values, "p4_found": p4_found, "p6_found": p6_found, "p6_split": p6_split, "p6_shares": p6_shares, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_profile": p10_profile}
CAMERA_SQL = "regexp_replace(trim({}), '^(observation[.]images[.]|images?[.])', '')"
SQL: dict[str, str] = {
    "p1_counts": """with f as (select any_value(dataset_name) as dataset_name, any_value(state) as state, any_value(action) as action from frames where frame_id is not null group by frame_id union all select dataset_name, state, action from frames where frame_id is null),
      c as (select dataset_name, 'state' as vector, unnest(generate_series(0, len(state) - 1)) as dim, unnest(state) as value from f where state is not null and len(state) > 0
        union all select dataset_name, 'action', unnest(generate_series(0, len(action) - 1)), unnest(action) from f where action is not null and len(action) > 0)
      select dataset_name, vector, cast(dim as bigint) as dim, count(*) as n from c where value is not null and isfinite(value) group by 1, 2, 3""",
    "p6_kept": "select count(distinct record_id) as records, count(distinct record_id) as rows, cast(0 as bigint) as torn from episodes where record_id is not null",
    "p9_kept": "select count(*) as documents, cast(0 as bigint) as split, cast(0 as bigint) as overfull from documents",
    "p4_found": f"""with im as (select image_id, min(repo_index) as r, min(episode_index) as e, min({CAMERA_SQL.format("video_key")}) as c, min(packed_ts) as p from camera_images
        where image_id is not null and repo_index is not null and episode_index is not null and video_key is not null and packed_ts is not null group by image_id),
      k as (select repo_index as r, episode_index as e, videos_json, unnest(json_keys(videos_json)) as key from episodes where videos_json is not null and repo_index is not null and episode_index is not null),
      v as (select r, e, {CAMERA_SQL.format("key")} as c, max(try_cast(json_extract_string(videos_json, '$."' || key || '".from_timestamp') as double)) as b from k group by 1, 2, 3),
      h as (select repo_index as r, 0.5 / coalesce(max(fps), max(try_cast(json_extract_string(info, '$.fps') as double))) + 1e-9 as tol from repos group by 1),
      t as (select image_id, im.r, im.e, im.c, p - coalesce(b, 0) as t, tol from im left join v on v.r = im.r and v.e = im.e and v.c = im.c join h on h.r = im.r),
      f as (select frame_id, min(repo_index) as r, min(episode_index) as e, min(step_ts) as s from frames where frame_id is not null and repo_index is not null and episode_index is not null and step_ts is not null group by frame_id),
      j as (select frame_id, image_id, abs(s - t) as d, tol, row_number() over (partition by frame_id, c order by abs(s - t), t, image_id) as n from f join t on t.r = f.r and t.e = f.e)
    select frame_id, image_id from j where n = 1 and d <= tol""",
    "p6_found": f"""with recursive e as (select record_id as r, min(path) as p, min(dataset_name) as n, min(episode_index) as i, min(extra_json) as x from episodes where record_id is not null group by 1),
      parents as (select r, trim(replace(unnest(regexp_extract_all(x, '"parent_id": *("[^"]*"|[0-9.]+)', 1)), '"', '')) as v from e),
      origins as (select r, n, replace(unnest(regexp_extract_all(x, '"derived_from": *("[^"]*")', 1)), '"', '') as v from e),
      keys as (select r, 'P|' || {resolved_sql("p", "n")} || '|' || coalesce(cast(i as varchar), '-') as k from e
        union select r, 'Q|' || v from parents where v <> ''
        union select r, 'P|' || {resolved_sql("regexp_extract(v, '^(.*)#([0-9]+)$', 1)", "n")} || '|' || cast(cast(regexp_extract(v, '^(.*)#([0-9]+)$', 2) as bigint) as varchar) from origins),
      near as (select distinct a.r, b.r as m from keys a join keys b on a.k = b.k),
      reach as (select r, m from near union select reach.r, near.m from reach join near on near.r = reach.m)
    select r as record_id, min(m) as group_id from reach group by r having count(*) > 1""",
}

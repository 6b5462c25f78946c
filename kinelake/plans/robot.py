"""Queries over the robot tables themselves, with their nulls, cut vectors, repeated and late rows, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.paths import camera_key, dataset_key
from kinelake.operators import joins, ranks, sampling, stats, temporal
from kinelake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EP = ["repo_index", "episode_index"]


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def told(x: Column) -> Column:
    """A number rounded for comparison; NaN is null."""
    return F.round(F.when(~F.isnan(x), x), 6)


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Each frame once, numbered in its episode; late copies add nothing."""
    kept = table(spark, d, "frames").filter("frame_id is not null and repo_index is not null and episode_index is not null and frame_index is not null")
    once = kept.groupBy("frame_id").agg(*[F.min(c).alias(c) for c in ("dataset_name", *EP, "frame_index", "step_ts", "task_index")], *[F.max_by(v, F.struct(F.col(v).isNotNull(), "ingested_at")).alias(v) for v in ("state", "action")])
    return temporal.numbered(once, EP, ["frame_index", "frame_id"])


STEPS = """once as (select frame_id, min(dataset_name) as dataset_name, min(repo_index) as repo_index, min(episode_index) as episode_index, min(frame_index) as frame_index, min(step_ts) as step_ts, min(task_index) as task_index,
    any_value(state) as state, any_value(action) as action from frames where frame_id is not null and repo_index is not null and episode_index is not null and frame_index is not null group by frame_id),
  steps as (select *, cast(row_number() over w - 1 as bigint) as frame, cast(count(*) over (partition by repo_index, episode_index) as bigint) as n from once window w as (partition by repo_index, episode_index order by frame_index, frame_id))"""


def cell(vector: str, dim: int) -> Column:
    return F.get(vector, F.lit(dim)).cast("double")


def cell_sql(vector: str, dim: int) -> str:
    x = f"cast({vector}[{dim + 1}] as double)"
    return f"round(case when not isnan({x}) then {x} end, 6)"


def limits(spark: SparkSession, d: str, vector: str) -> DataFrame:
    """(dataset_name, dim, lo, hi) of what each dataset's embodiment can reach."""
    specs = table(spark, d, "specs").select(F.col("name").alias("dataset_name"), "embodiment").distinct()
    told_ = table(spark, d, "joint_limits").filter(F.col("vector") == vector).select("embodiment", F.col("dim").cast("long").alias("dim"), "lo", "hi").distinct()
    return specs.join(told_, "embodiment").select("dataset_name", "dim", "lo", "hi")


def reached(spark: SparkSession, d: str, vector: str) -> DataFrame:
    """(frame_id, dataset_name, dim, value) of the readings of a vector that the embodiment can reach."""
    c = steps(spark, d).select("frame_id", "dataset_name", *EP, "frame", F.posexplode(vector).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.col("value").cast("double"))
    return c.join(limits(spark, d, vector), ["dataset_name", "dim"]).filter("value between lo and hi and not isnan(value)").drop("lo", "hi")


def reached_sql(vector: str) -> str:
    return f"""lim as (select distinct s.name as dataset_name, cast(l.dim as bigint) as dim, l.lo, l.hi from specs s join joint_limits l on l.embodiment = s.embodiment and l.vector = '{vector}'),
  cells as (select c.frame_id, c.dataset_name, c.repo_index, c.episode_index, c.frame, c.dim, c.value from (select frame_id, dataset_name, repo_index, episode_index, frame, cast(unnest(generate_series(0, len({vector}) - 1)) as bigint) as dim, cast(unnest({vector}) as double) as value from steps where {vector} is not null and len({vector}) > 0) c
    join lim on lim.dataset_name = c.dataset_name and lim.dim = c.dim where c.value between lim.lo and lim.hi and not isnan(c.value))"""


@query(f"with {STEPS} select repo_index, episode_index, max(n) as n, min(frame_index) as first, max(frame_index) as last, cast(max(frame_index) - min(frame_index) + 1 - count(distinct frame_index) as bigint) as gaps, cast(count(*) filter (where step_ts is null) as bigint) as untimed from steps group by 1, 2")
def robot_episode_lengths(spark, d):
    """Frames of each episode, lost frames and frames without time."""
    by = steps(spark, d).groupBy(*EP).agg(F.max("n").alias("n"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"), F.count_distinct("frame_index").alias("k"), F.count_if(F.col("step_ts").isNull()).alias("untimed"))
    return by.select(*EP, "n", "first", "last", (F.col("last") - F.col("first") + 1 - F.col("k")).alias("gaps"), "untimed")


CHUNK = [0, 2, 4, 6]


@query(f"""with {STEPS}, k as (select cast(i as bigint) as k, i * 2 as d from generate_series(0, 3) g(i))
  select a.repo_index, a.episode_index, a.frame, k.k, b.frame as src, {cell_sql("b.action", 0)} as value from steps a cross join k join steps b on b.repo_index = a.repo_index and b.episode_index = a.episode_index and b.frame = least(a.frame + k.d, a.n - 1)""")
def robot_action_chunk(spark, d):
    """Future actions of every step at twice its period, clamped to the episode; lost vectors are null."""
    got = temporal.gather(steps(spark, d).select(*EP, "frame", "n", cell("action", 0).alias("value")), EP, CHUNK, ["value"])
    return got.select(*EP, "frame", "k", "src", told(F.col("value")).alias("value"))


@query(f"""with {STEPS}, s as (select name, max(fps) as fps from specs group by name), f as (select steps.*, fps from steps join s on s.name = steps.dataset_name), t as (select f.*, g.k, frame + (g.k - 3) / 10.0 * fps as target from f cross join generate_series(0, 3) g(k)),
  i as (select *, cast(floor(target + 1e-9) as bigint) as idx from t)
  select i.repo_index, i.episode_index, i.frame, cast(i.k as bigint) as k, b.frame as src, idx >= 0 and target - idx <= i.fps / 10.0 + 1e-9 as valid, round((b.frame - i.frame) / i.fps, 6) as "offset", {cell_sql("b.state", 0)} as value
  from i join steps b on b.repo_index = i.repo_index and b.episode_index = i.episode_index and b.frame = greatest(i.idx, 0)""")
def robot_history_timed(spark, d):
    """Causal history of 0.4 s at 10 Hz, each dump at its spec's rate."""
    fps = table(spark, d, "specs").groupBy(F.col("name").alias("dataset_name")).agg(F.max("fps").alias("fps"))
    f = steps(spark, d).join(fps, "dataset_name").select(*EP, "frame", "n", "fps", cell("state", 0).alias("value"))
    got = temporal.timed_history(f, EP, F.col("fps"), 0.4, 10.0, ["value"])
    return got.select(*EP, "frame", "k", "src", "valid", F.round("offset", 6).alias("offset"), told(F.col("value")).alias("value"))


OBS = f"""{STEPS}, obs as (select repo_index, episode_index, step_ts as t, min(frame_id) as frame_id from steps where step_ts is not null and not isnan(step_ts) group by 1, 2, 3)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    timed = steps(spark, d).filter("step_ts is not null and not isnan(step_ts)")
    return timed.groupBy(*EP, F.col("step_ts").alias("t")).agg(F.min("frame_id").alias("frame_id"))


@query(f"""with {OBS}, q as (select repo_index, episode_index, t as now, g.k, (g.k - 1) / 5.0 as o from obs cross join generate_series(0, 1) g(k)),
  firsts as (select repo_index, episode_index, min(t) as t0, arg_min(frame_id, t) as f0 from obs group by 1, 2),
  j as (select q.*, obs.t, obs.frame_id from q asof left join obs on q.repo_index = obs.repo_index and q.episode_index = obs.episode_index and q.now + q.o + 1e-9 >= obs.t)
  select j.repo_index, j.episode_index, round(now, 6) as now, cast(k as bigint) as k, t is not null and o - (coalesce(t, t0) - now) <= 0.2 + 1e-9 as valid, round(coalesce(t, t0) - now, 6) as "offset", coalesce(frame_id, f0) as frame_id
  from j join firsts on firsts.repo_index = j.repo_index and firsts.episode_index = j.episode_index""")
def robot_history_timestamp(spark, d):
    """As-of history by the steps' own times; steps without one take no part."""
    got = temporal.timestamp_history(observations(spark, d), EP, "t", 0.4, 5.0, ["frame_id"])
    return got.select(*EP, F.round("now", 6).alias("now"), "k", "valid", F.round("offset", 6).alias("offset"), "frame_id")


@query(f"""with {STEPS}, x as (select *, case when frame = 0 or task_index is distinct from lag(task_index) over (partition by repo_index, episode_index order by frame) then 1 else 0 end as new from steps),
  r as (select *, sum(new) over (partition by repo_index, episode_index order by frame) as run from x) select repo_index, episode_index, min(frame) as start, max(frame) + 1 as stop, min(task_index) as task_index from r group by repo_index, episode_index, run""")
def robot_task_runs(spark, d):
    """Runs of equal tasks in each episode."""
    return temporal.run_segments(steps(spark, d), EP, "task_index").select(*EP, "start", "stop", "task_index")


CAM_SQL = "regexp_replace(trim({}), '^(observation[.]images[.]|images?[.])', '')"


@query(f"""with {OBS}, im as (select image_id, min(repo_index) as r, min(episode_index) as e, {CAM_SQL.format("min(video_key)")} as camera, min(packed_ts) as p from camera_images group by image_id),
  i as (select r, e, camera, p, max(image_id) as image_id from im where image_id is not null and r is not null and e is not null and camera is not null and camera <> '' and p is not null group by 1, 2, 3, 4),
  q as (select obs.*, c.camera from obs join (select distinct r, e, camera from i) c on c.r = obs.repo_index and c.e = obs.episode_index)
  select q.frame_id, q.camera, coalesce(i.image_id, -1) as image_id from q asof left join i on q.repo_index = i.r and q.episode_index = i.e and q.camera = i.camera and q.t >= i.p""")
def robot_last_image(spark, d):
    """The last image of each camera at or before each step, in packed time; -1 before the first."""
    im = table(spark, d, "camera_images").groupBy("image_id").agg(*[F.min(c).alias(c) for c in (*EP, "video_key", "packed_ts")]).select("image_id", *EP, camera_key(F.col("video_key")).alias("camera"), F.col("packed_ts").alias("p")).dropna()
    im = im.groupBy(*EP, "camera", "p").agg(F.max("image_id").alias("image_id"))
    ticks = observations(spark, d).join(im.select(*EP, "camera").distinct(), EP)
    return joins.asof(ticks, im, [*EP, "camera"], "t", "p", ["image_id"], clip=False, block=3600.0).select("frame_id", "camera", F.coalesce("image_id", F.lit(-1).cast("long")).alias("image_id"))


@query(f"with {STEPS}, {reached_sql('state')} select dataset_name, dim, round(avg(value), 5) as mean, round(stddev_pop(value), 5) as std, min(value) as min, max(value) as max, cast(count(*) as bigint) as count from cells group by 1, 2")
def robot_moments(spark, d):
    """Moments of the states that each dataset's embodiment can reach."""
    got = stats.moments(reached(spark, d, "state"), ["dataset_name", "dim"])
    return got.select("dataset_name", "dim", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "min", "max", "count")


@query(f"with {STEPS}, {reached_sql('action')} select dataset_name, dim, round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99 from cells group by 1, 2")
def robot_quantiles(spark, d):
    """Exact quantiles of the actions that each dataset's embodiment can reach."""
    got = stats.quantiles(reached(spark, d, "action"), ["dataset_name", "dim"], {"q01": 0.01, "q50": 0.5, "q99": 0.99})
    return got.select("dataset_name", "dim", *[F.round(q, 6).alias(q) for q in ("q01", "q50", "q99")])


@query(f"""with {STEPS}, c as (select dataset_name, cast(unnest(generate_series(0, len(state) - 1)) as bigint) as dim, cast(unnest(state) as double) as value from steps where state is not null and len(state) > 0)
  select dataset_name, dim, cast(count(*) as bigint) as n, round(quantile_cont(value, 0.05), 6) as q05, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.95), 6) as q95 from c where value is not null and not isnan(value) group by 1, 2""")
def robot_vector_quantiles(spark, d):
    """Exact quantiles of all state readings, impossible ones too, by radix selection."""
    got = ranks.vector_quantiles(steps(spark, d), ["dataset_name"], "state", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return got.select("dataset_name", "dim", "n", *[F.round(q, 6).alias(q) for q in ("q05", "q50", "q95")])


@query(f"""with {STEPS}, {reached_sql('state')}, f as (select a.dataset_name, a.dim, round(b.value - a.value, 5) as value from cells a join cells b on b.repo_index = a.repo_index and b.episode_index = a.episode_index and b.dim = a.dim and b.frame = a.frame + 1)
  select dataset_name, dim, round(avg(value), 5) as mean, min(value) as min, max(value) as max, round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.99), 6) as q99, cast(count(*) as bigint) as count from f group by 1, 2""")
def robot_delta_stats(spark, d):
    """Statistics of each joint's change from one step to the next, where both can be reached."""
    w = W.partitionBy(*EP, "dim").orderBy("frame")
    change = reached(spark, d, "state").withColumn("_next", F.when(F.lead("frame").over(w) == F.col("frame") + 1, F.lead("value").over(w))).select("dataset_name", "dim", F.round(F.col("_next") - F.col("value"), 5).alias("value")).filter("value is not null")
    by = ["dataset_name", "dim"]
    both = stats.moments(change, by).join(stats.quantiles(change, by, {"q01": 0.01, "q99": 0.99}), by)
    return both.select(*by, F.round("mean", 5).alias("mean"), "min", "max", F.round("q01", 6).alias("q01"), F.round("q99", 6).alias("q99"), "count")


@query(f"""with {STEPS}, c as (select dataset_name, unnest(state) as value from steps), s as (select name, max(state_dim) as dim from specs group by name),
  v as (select dataset_name, cast(count(*) filter (where state is null) as bigint) as lost, cast(count(*) filter (where len(state) < dim) as bigint) as short from steps join s on s.name = dataset_name group by 1)
  select v.dataset_name, lost, short, cast(count(c.dataset_name) filter (where c.value is null) as bigint) as empty, cast(count(*) filter (where isnan(c.value)) as bigint) as nan, cast(count(*) filter (where isinf(c.value)) as bigint) as inf from v left join c on c.dataset_name = v.dataset_name group by 1, 2, 3""")
def robot_not_finite(spark, d):
    """Lost and short state vectors of each dataset, and cells that are empty, NaN or infinite."""
    dims = table(spark, d, "specs").groupBy(F.col("name").alias("dataset_name")).agg(F.max("state_dim").alias("dim"))
    s = steps(spark, d).join(dims, "dataset_name")
    whole = s.groupBy("dataset_name").agg(F.count_if(F.col("state").isNull()).alias("lost"), F.count_if(F.col("state").isNotNull() & (F.size("state") < F.col("dim"))).alias("short"))
    cells = s.select("dataset_name", F.explode("state").alias("value"))
    bad = stats.not_finite(cells, ["dataset_name"]).join(cells.groupBy("dataset_name").agg(F.count_if(F.col("value").isNull()).alias("empty")), "dataset_name")
    return whole.join(bad, "dataset_name", "left").select("dataset_name", "lost", "short", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("empty", "nan", "inf")])


@query(f"""with {STEPS}, {reached_sql('state')}, q as (select dataset_name, dim, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi from cells group by 1, 2)
  select frame_id, c.dim, round((value - lo) / (hi - lo + 1e-6) * 2 - 1, 4) as value from cells c join q on q.dataset_name = c.dataset_name and q.dim = c.dim""")
def robot_normalize(spark, d):
    """Joints on the scale of their dataset's 1st and 99th percentile, as far as they can be reached."""
    cells = reached(spark, d, "state").select("frame_id", "dataset_name", "dim", "value")
    q = stats.quantiles(cells, ["dataset_name", "dim"], {"lo": 0.01, "hi": 0.99})
    return cells.join(q, ["dataset_name", "dim"]).select("frame_id", "dim", F.round(stats.normalize(F.col("value"), F.col("lo"), F.col("hi")), 4).alias("value"))


@query("""with e as (select record_id, min(path) as p, min(episode_index) as i from episodes where record_id is not null group by 1), x as (select record_id, md5(concat_ws('|', coalesce(p, ''), coalesce(cast(i as varchar), ''))) as g from e),
  r as (select g, row_number() over (order by md5('9:' || g)) as n, count(*) over () as total from (select distinct g from x)) select record_id, n <= least(total - 1, greatest(1, cast(floor(total * 0.1) as bigint))) as held from x join r on r.g = x.g""")
def robot_holdout(spark, d):
    """A tenth of the places (path and episode) held out whole."""
    e = table(spark, d, "episodes").filter("record_id is not null").groupBy("record_id").agg(F.min("path").alias("p"), F.min("episode_index").alias("i"))
    g = F.md5(F.concat_ws("|", F.coalesce("p", F.lit("")), F.coalesce(F.col("i").cast("string"), F.lit(""))))
    return sampling.holdout(e.select("record_id", g.alias("g")), "g", 0.1, 9).select("record_id", "held")


@query("""with e as (select record_id as episode, max(n_frames) as n from episodes where record_id is not null group by 1 having max(n_frames) > 0), o as (select episode, n, row_number() over (order by episode) - 1 as r, count(*) over () as total from e),
  p as (select distinct cast(floor(k * (total - 1) / 49.0) as bigint) as r from (select max(total) as total from o) t, generate_series(0, 49) g(k)) select episode, cast(0 as bigint) as frame from o join p on p.r = o.r""")
def robot_balanced_validation(spark, d):
    """Fifty validation frames spread over all episodes that have frames; fewer than there are episodes."""
    e = table(spark, d, "episodes").filter("record_id is not null").groupBy(F.col("record_id").alias("episode")).agg(F.max("n_frames").alias("n")).filter("n > 0")
    return sampling.balanced_sample(e, "episode", "n", 50)


@query("""select repo_index, coalesce(max(fps), max(try_cast(trim(json_extract_string(info, '$.fps')) as double)), 0.0) as fps, cast(count(*) as bigint) as copies from repos where repo_index is not null group by 1""")
def robot_dump_rates(spark, d):
    """The rate of each dump: its own, else the one in info, which may be text."""
    inner = F.expr("try_cast(trim(get_json_object(info, '$.fps')) as double)")
    return table(spark, d, "repos").filter("repo_index is not null").groupBy("repo_index").agg(F.coalesce(F.max("fps"), F.max(inner), F.lit(0.0)).alias("fps"), F.count(F.lit(1)).alias("copies"))


@query("""with t as (select record_id, min(trim(lang)) as lang, min(regexp_extract(regexp_replace(trim(dataset_name), '[\\\\/]+$', ''), '([^\\\\/]*)$', 1)) as ds from episodes where record_id is not null group by 1),
  x as (select record_id, nullif(trim(ds), '') as ds, case when instr(lang, '@') > 0 and regexp_matches(substr(lang, 1, instr(lang, '@') - 1), '[一-鿿]') and trim(substr(lang, instr(lang, '@') + 1)) <> '' then trim(substr(lang, instr(lang, '@') + 1)) else lang end as lang from t)
  select record_id, ds as dataset_name, coalesce(nullif(lang, ''), ds, '') as instruction from x""")
def robot_instructions(spark, d):
    """The instruction of each record: the English part where two languages are given, the dataset's name where none is."""
    t = table(spark, d, "episodes").filter("record_id is not null").groupBy("record_id").agg(F.min(F.trim("lang")).alias("lang"), F.min(dataset_key(F.col("dataset_name"))).alias("dataset_name"))
    said = F.nullif(joins.english(F.col("lang")), F.lit(""))
    return t.select("record_id", "dataset_name", F.coalesce(said, "dataset_name", F.lit("")).alias("instruction"))

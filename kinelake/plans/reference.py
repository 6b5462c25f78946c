"""Queries over the operators on episodes, frames, samples and caches, each with its SQL twin.

The tables of events, embeddings, orders, line items and documents stand for
episodes of a robot: a user's events are an episode's steps, a label's vectors
a trajectory, an order's items a packed episode, a customer a parent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators import batching, caches, flow, geometry, joins, sampling, space, stats, temporal
from kinelake.session import table
from kinelake.streaming import history, wire
from kinelake.spec import ActionSlice, EMBODIMENT_IDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# proxies


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.col("user_id").alias("episode"), "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    return temporal.numbered(e, ["episode"], ["us", "event_id"])


FRAMES = """frames as (
  select user_id as episode, event_id, event_type, epoch_us(ts) as us, value, cast(json_extract_string(props, '$.k') as double) as k,
    cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as frame,
    cast(count(*) over (partition by user_id) as bigint) as n
  from events)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("episode"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return temporal.numbered(v, ["episode"], ["vec_id"])


VECTORS = """vectors as (
  select cast(label as bigint) as episode, vec_id, cast(embedding as double[]) as v,
    cast(row_number() over (partition by label order by vec_id) - 1 as bigint) as frame,
    cast(count(*) over (partition by label) as bigint) as n
  from embeddings)"""

PACKED_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def packed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").cast("long").alias("frame"), "l_returnflag", *PACKED_COLUMNS)


CELLS = """cells as (
  select l_orderkey as episode, cast(l_linenumber as bigint) as frame, l_returnflag, u.dim, u.value from lineitem,
    lateral (select cast(0 as bigint) as dim, l_quantity as value union all select 1, l_extendedprice union all select 2, l_discount union all select 3, l_tax) u)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).select("episode", "frame", "l_returnflag", F.posexplode(F.array(*PACKED_COLUMNS)).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))


def r6(c):
    return F.round(c, 6)


# sources, projections, lookups


@query("select user_id as episode, cast(count(*) as bigint) as n, round(sum(value), 4) as total from events group by user_id having count(*) > 0")
def episode_index(spark, d):
    return frames(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).filter("n > 0")


@query("select l_orderkey as episode, cast(count(*) as bigint) as n from lineitem group by l_orderkey")
def episode_fallback_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CELLS} select episode, frame, dim, value from cells")
def pack_columns(spark, d):
    whole = packed(spark, d).withColumn("v", space.pack([F.col(c) for c in PACKED_COLUMNS], {0, 1, 2, 3}, 4, "double"))
    return whole.select("episode", "frame", F.posexplode("v").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))


def _fit(spark, d, dim):
    v = vectors(spark, d).select("vec_id", space.fit_dim(F.col("v"), dim, "double").alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query(f"with {VECTORS} select vec_id, cast(i as bigint) as dim, round(coalesce(v[i + 1], 0), 6) as value from vectors, generate_series(0, 79) g(i)")
def fit_dim_pad(spark, d):
    return _fit(spark, d, 80)


@query(f"with {VECTORS} select vec_id, cast(i as bigint) as dim, round(v[i + 1], 6) as value from vectors, generate_series(0, 15) g(i)")
def fit_dim_cut(spark, d):
    return _fit(spark, d, 16)


@query("""select c_custkey, cast(coalesce(n_regionkey, 31) as bigint) as region from customer left join (select * from nation where n_regionkey < 3) n on c_nationkey = n_nationkey""")
def task_lookup_default(spark, d):
    told = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_regionkey").cast("long").alias("region"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("key"))
    return joins.lookup(rows, told, "key", "region", F.lit(31).cast("long")).select("c_custkey", "region")


@query("""with told as (select n_regionkey as task, cast(n_nationkey as varchar) as episode, n_name as text from nation where n_nationkey % 2 = 0
    union all select r_regionkey, '*', r_name from region where r_regionkey <> 1)
  select n_nationkey, coalesce(a.text, b.text, '') as text from nation
    left join told a on a.task = n_regionkey and a.episode = cast(n_nationkey as varchar) left join told b on b.task = n_regionkey and b.episode = '*'""")
def instruction_fallback(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    own = nation.filter("n_nationkey % 2 = 0").select(F.col("n_regionkey").cast("long").alias("task"), F.col("n_nationkey").cast("string").alias("episode"), F.col("n_name").alias("text"))
    any_ = region.filter("r_regionkey <> 1").select(F.col("r_regionkey").cast("long"), F.lit("*"), "r_name")
    rows = nation.select("n_nationkey", F.col("n_regionkey").cast("long").alias("task"), F.col("n_nationkey").cast("string").alias("episode"))
    return joins.instruction(rows, own.union(any_), "task", "episode", "text").select("n_nationkey", "text")


@query("""with t as (select doc_id, case doc_id % 4 when 0 then '打开@' || coalesce(lang, '') when 1 then '打开@ ' when 2 then 'open@' || coalesce(lang, '') else coalesce(lang, '') end as text from documents)
  select doc_id, case when instr(text, '@') > 0 and regexp_matches(substr(text, 1, instr(text, '@') - 1), '[一-鿿]') and trim(substr(text, instr(text, '@') + 1)) <> '' then trim(substr(text, instr(text, '@') + 1)) else text end as text from t""")
def cjk_instruction(spark, d):
    lang = F.coalesce("lang", F.lit(""))
    k = F.col("doc_id") % 4
    text = F.when(k == 0, F.concat(F.lit("打开@"), lang)).when(k == 1, F.lit("打开@ ")).when(k == 2, F.concat(F.lit("open@"), lang)).otherwise(lang)
    return table(spark, d, "documents").select("doc_id", joins.english(text).alias("text"))


@query("""select cast(c as bigint) as c, cast(n as bigint) as n, cast(stride as bigint) as stride from (values (0, 10, 2), (1, 10, 2), (2, 2, 3), (3, 16, 1), (4, 1, 30)) t(c, n, stride)""")
def delta_constants(spark, d):
    cases = [(1.0, 10, 15), (1.0, 10, 25), (0.2, 10, 30), (1.6, 10, 10), (0.0, 1, 30)]
    rows = [(i, temporal.n_steps(s, f), temporal.native_stride(fps, f)) for i, (s, f, fps) in enumerate(cases)]
    return spark.createDataFrame(rows, "c long, n long, stride long")


# windows

DELTAS = temporal.delta_indices(0.4, 10, 30)  # 0, 3, 6, 9


@query(f"""with {FRAMES}, w as (select episode, frame, n, k, least(frame + k * 3, n - 1) as src from frames, generate_series(0, 3) g(k))
  select w.episode, w.frame, cast(w.k as bigint) as k, f.frame as src, f.value from w join frames f on f.episode = w.episode and f.frame = w.src""".replace("select episode, frame, n, k, least", "select frames.episode, frames.frame, frames.n, g.k, least").replace("frame + k * 3", "frame + g.k * 3"))
def action_chunk(spark, d):
    return temporal.gather(frames(spark, d), ["episode"], DELTAS, ["value"]).select("episode", "frame", "k", "src", "value")


@query(SQL["action_chunk"])
def action_chunk_arrays(spark, d):
    return temporal.gather(frames(spark, d), ["episode"], DELTAS, ["value"], longest=1000).select("episode", "frame", "k", "src", "value")


RUNS = """runs as (
  select episode, min(frame) as start, max(frame) + 1 as stop, min(event_type) as event_type from (
    select *, sum(case when prev = event_type then 0 else 1 end) over (partition by episode order by frame) as run from (
      select *, lag(event_type) over (partition by episode order by frame) as prev from frames)) group by episode, run)"""


@query(f"with {FRAMES}, {RUNS} select episode, cast(start as bigint) as start, cast(stop as bigint) as stop, event_type from runs")
def segments_rle(spark, d):
    return temporal.run_segments(frames(spark, d), ["episode"], "event_type").select("episode", "start", "stop", "event_type")


@query(f"""with {FRAMES}, {RUNS}, s as (select f.episode, f.frame, r.stop from frames f join runs r on r.episode = f.episode and f.frame >= r.start and f.frame < r.stop)
  select s.episode, s.frame, cast(g.k as bigint) as k, f.value from s, generate_series(0, 3) g(k) join frames f on f.episode = s.episode and f.frame = least(s.frame + g.k * 3, s.stop - 1)""".replace("from s, generate_series(0, 3) g(k) join", "from s cross join generate_series(0, 3) g(k) join"))
def action_chunk_segment_clamp(spark, d):
    f = frames(spark, d)
    runs = temporal.run_segments(f, ["episode"], "event_type").select("episode", "start", "stop")
    inside = joins.interval_join(f, runs, ["episode"], "frame")
    return temporal.gather_join(inside, ["episode"], DELTAS, ["value"], upper=F.col("stop")).select("episode", "frame", "k", "value")


@query(f"""with {FRAMES} select a.episode, a.frame, cast(g.k as bigint) as k, f.value from frames a cross join generate_series(0, 2) g(k)
  join frames f on f.episode = a.episode and f.frame = greatest(least(a.frame + (g.k - 2) * 2, a.n - 1), 0)""")
def image_history_legacy(spark, d):
    return temporal.gather_join(frames(spark, d), ["episode"], temporal.delta_indices(0.3, 10, 20, past=True), ["value"]).select("episode", "frame", "k", "value")


@query(f"""with {FRAMES}, t as (select episode, frame, g.k, frame + (g.k - 3) / 10.0 * 15 as target from frames cross join generate_series(0, 3) g(k)),
  i as (select *, cast(floor(target + 1e-9) as bigint) as idx from t)
  select i.episode, i.frame, cast(i.k as bigint) as k, f.frame as src, idx >= 0 and target - idx <= 1.5 + 1e-9 as valid, round((f.frame - i.frame) / 15.0, 6) as "offset", f.value
  from i join frames f on f.episode = i.episode and f.frame = greatest(i.idx, 0)""")
def history_timed(spark, d):
    got = temporal.timed_history(frames(spark, d), ["episode"], 15.0, 0.4, 10.0, ["value"])
    return got.select("episode", "frame", "k", "src", "valid", r6("offset").alias("offset"), "value")


@query(f"""with {FRAMES}, s as (select episode, us / 86400000000.0 as t, frame, value from frames),
  q as (select episode, t as now, g.k, (g.k - 3) / 2.0 as o from s cross join generate_series(0, 3) g(k)),
  firsts as (select episode, t as t0, value as v0 from s where frame = 0),
  j as (select q.*, s.t, s.value from q asof left join s on q.episode = s.episode and q.now + q.o + 1e-9 >= s.t)
  select j.episode, round(now, 6) as now, cast(k as bigint) as k, t is not null and o - (coalesce(t, t0) - now) <= 0.5 + 1e-9 as valid, round(coalesce(t, t0) - now, 6) as "offset", coalesce(value, v0) as value
  from j join firsts on firsts.episode = j.episode""")
def history_timestamp(spark, d):
    obs = frames(spark, d).select("episode", (F.col("us") / 86400000000.0).alias("t"), "value")
    got = temporal.timestamp_history(obs, ["episode"], "t", 2.0, 2.0, ["value"])
    return got.select("episode", r6("now").alias("now"), "k", "valid", r6("offset").alias("offset"), "value")


@query("""with e as (select user_id as episode, count(*) as n from events group by user_id)
  select episode, cast(n as bigint) as n, cast(sum(n) over (order by episode) - n as bigint) as start, cast(sum(n) over (order by episode) as bigint) as stop from e""")
def sample_index(spark, d):
    return temporal.sample_index(frames(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("n")), ["episode"]).select("episode", "n", "start", "stop")


def _derived(mode):
    less = "" if mode == "abs" else " - a.value"
    return f"with {FRAMES} select a.episode, a.frame, round(b.value{less}, 6) as action from frames a join frames b on b.episode = a.episode and b.frame = least(a.frame + 3, a.n - 1)"


@query(_derived("abs"))
def derived_actions_abs(spark, d):
    return temporal.derived_actions(frames(spark, d), ["episode"], "value", 3).select("episode", "frame", r6("action").alias("action"))


@query(_derived("rel"))
def derived_actions_rel(spark, d):
    return temporal.derived_actions(frames(spark, d), ["episode"], "value", 3, "rel").select("episode", "frame", r6("action").alias("action"))


KEPT = "kept as (select * from runs where event_type <> 'view')"


@query(f"""with {FRAMES}, {RUNS}, {KEPT} select f.episode, f.frame, cast(row_number() over (partition by f.episode order by f.frame) - 1 as bigint) as sample, cast(k.start as bigint) as lower, cast(k.stop as bigint) as upper, k.event_type
  from frames f join kept k on k.episode = f.episode and f.frame >= k.start and f.frame < k.stop""")
def segment_samples(spark, d):
    runs = temporal.run_segments(frames(spark, d), ["episode"], "event_type").filter("event_type <> 'view'")
    return temporal.segment_samples(runs, ["episode"], ["event_type"]).select("episode", "frame", "sample", "lower", "upper", "event_type")


@query(f"""with {FRAMES}, p as (select episode, frame, case when event_type = 'view' then ' ' else event_type end as text, cast(1 + frame % 3 as bigint) as len from frames),
  c as (select *, sum(len) over (partition by episode order by frame) as z from p), k as (select *, z - len as a from c where trim(text) <> ''),
  m as (select *, case when lag(z) over w = a and lag(text) over w = text then 0 else 1 end as new from k window w as (partition by episode order by frame)),
  r as (select *, sum(new) over (partition by episode order by frame) as run from m)
  select episode, min(text) as text, round(min(a) / 10.0, 6) as start, round(max(z) / 10.0, 6) as "end" from r group by episode, run""")
def annotation_spans_merge(spark, d):
    parts = frames(spark, d).select("episode", "frame", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("text"), (1 + F.col("frame") % 3).alias("len"))
    return temporal.merge_spans(parts, ["episode"], "frame", "text", "len", 10).select("episode", "text", r6("start").alias("start"), r6("end").alias("end"))


OVERLAP = "spans as (select user_id as episode, max(a) as t0, min(z) as t1 from (select user_id, event_type, min(epoch_us(ts)) as a, max(epoch_us(ts)) as z from events group by 1, 2) group by 1)"


@query(f"with {OVERLAP} select episode, cast(t0 as bigint) as t0, cast(t1 as bigint) as t1 from spans")
def topic_overlap(spark, d):
    return joins.overlap(frames(spark, d), ["episode"], "event_type", "us")


TICK = 86_400_000_000


def _resample_sql(op: str) -> str:
    return f"""with {OVERLAP}, ticks as (select episode, unnest(generate_series(t0, t1, {TICK})) as tick from spans where t0 <= t1),
      topics as (select distinct user_id as episode, event_type from events),
      obs as (select user_id as episode, event_type, epoch_us(ts) as us, max(value) as value from events group by 1, 2, 3),
      q as (select ticks.episode, tick, event_type from ticks join topics on topics.episode = ticks.episode),
      firsts as (select episode, event_type, arg_min(value, us) as v0 from obs group by 1, 2),
      j as (select q.*, obs.value from q asof left join obs on q.episode = obs.episode and q.event_type = obs.event_type and q.tick {op} obs.us)
      select j.episode, cast(tick as bigint) as tick, j.event_type, coalesce(value, v0) as value from j join firsts on firsts.episode = j.episode and firsts.event_type = j.event_type"""


def _resample(spark, d, strict):
    f = frames(spark, d)
    ticks = temporal.grid(joins.overlap(f, ["episode"], "event_type", "us"), TICK).select("episode", "tick")
    topics = f.select("episode", "event_type").distinct()
    return joins.asof(ticks.join(topics, "episode"), f, ["episode", "event_type"], "tick", "us", ["value"], strict, block=7 * TICK).select("episode", "tick", "event_type", "value")


@query(_resample_sql(">="))
def resample_grid(spark, d):
    return _resample(spark, d, False)


@query(_resample_sql(">"))
def asof_strict(spark, d):
    return _resample(spark, d, True)


@query(f"with {FRAMES} select a.episode, a.frame, a.value as state, b.value as action from frames a join frames b on b.episode = a.episode and b.frame = a.frame + 1")
def next_state_action(spark, d):
    return temporal.next_state_actions(frames(spark, d), ["episode"], "value").select("episode", "frame", F.col("value").alias("state"), "action")


@query(f"""with {VECTORS}, t as (select a.vec_id, a.v as own, coalesce(b.v, a.v) as nxt from vectors a left join vectors b on b.episode = a.episode and b.frame = a.frame + 1)
  select vec_id, cast(i as bigint) as dim, round(case when i = 7 then own[33] when i = 15 then own[34] else nxt[i + 1] end, 6) as value from t, generate_series(0, 15) g(i)""")
def gripper_target_splice(spark, d):
    w = W.partitionBy("episode").orderBy("frame")
    v = vectors(spark, d).withColumn("nxt", F.coalesce(F.lead("v").over(w), F.col("v")))
    grips = [(7, 8, F.array(F.get("v", F.lit(32)))), (15, 16, F.array(F.get("v", F.lit(33))))]
    out = v.select("vec_id", space.splice(F.slice("nxt", 1, 16), grips, 16).alias("t"))
    return out.select("vec_id", F.posexplode("t").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


# statistics


@query(f"with {CELLS} select dim, round(avg(value), 8) as mean, round(stddev_pop(value), 8) as std, min(value) as min, max(value) as max, cast(count(value) as bigint) as count from cells group by dim")
def norm_moments(spark, d):
    got = stats.moments(cells(spark, d), ["dim"])
    return got.select("dim", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "min", "max", "count")


QS = {"q01": 0.01, "q50": 0.5, "q99": 0.99}
Q_SQL = "round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.99), 6) as q99"


@query(f"with {CELLS} select dim, {Q_SQL} from cells group by dim")
def norm_quantiles(spark, d):
    return stats.quantiles(cells(spark, d), ["dim"], QS).select("dim", *[r6(k).alias(k) for k in QS])


@query(SQL["norm_quantiles"])
def norm_quantiles_bounded(spark, d):
    return stats.quantiles_bounded(cells(spark, d), ["dim"], QS).select("dim", *[r6(k).alias(k) for k in QS])


STAT_SQL = "round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, min(value) as min, max(value) as max, round(quantile_cont(value, 0.01), 6) as q01, round(quantile_cont(value, 0.99), 6) as q99, cast(count(value) as bigint) as count"


def _stat(df, by):
    both = stats.moments(df, by).join(stats.quantiles_bounded(df, by, {"q01": 0.01, "q99": 0.99}), by)
    return both.select(*by, r6("mean").alias("mean"), r6("std").alias("std"), "min", "max", r6("q01").alias("q01"), r6("q99").alias("q99"), "count")


@query(f"""with {FRAMES}, c as (select g.k, round(f.value - a.value, 4) as value from frames a cross join generate_series(0, 3) g(k) join frames f on f.episode = a.episode and f.frame = least(a.frame + g.k * 3, a.n - 1))
  select cast(k as bigint) as k, {STAT_SQL} from c group by k""")
def norm_stats_rel(spark, d):
    f = frames(spark, d)
    own = f.select("episode", "frame", F.col("value").alias("state"))
    chunk = temporal.gather(f, ["episode"], DELTAS, ["value"]).join(own, ["episode", "frame"])
    return _stat(chunk.select("k", F.round(F.col("value") - F.col("state"), 4).alias("value")), ["k"])


@query(f"""with {FRAMES}, c as (select event_type, round(value - coalesce(lag(value) over (partition by episode order by frame), value), 4) as value from frames) select event_type, {STAT_SQL} from c group by event_type""")
def norm_stats_delta(spark, d):
    w = W.partitionBy("episode").orderBy("frame")
    step = frames(spark, d).select("event_type", F.round(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value")), 4).alias("value"))
    return _stat(step, ["event_type"])


@query(f"with {CELLS} select dim, cast(count(*) filter (where isnan(value)) as bigint) as nan, cast(count(*) filter (where isinf(value)) as bigint) as inf from cells group by dim")
def finite_check(spark, d):
    return stats.not_finite(cells(spark, d), ["dim"])


# action space

JOINTS = (ActionSlice("arm", 0, 2, "rel", "joint"),)


def _chunks(spark, d, rep):
    """Chunks of (value, k) of every frame, in the training space of ``rep``, and the space."""
    sp = (ActionSlice("arm", 0, 2, rep, "joint"),)
    f = frames(spark, d).select("episode", "frame", "n", F.array("value", "k").alias("s"))
    got = temporal.gather(f, ["episode"], DELTAS, ["s"])
    by = got.groupBy("episode", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("chunk"))
    return by.join(f.select("episode", "frame", F.col("s").alias("state")), ["episode", "frame"]), sp


def _exploded(df, chunk):
    return df.select("episode", "frame", F.posexplode(chunk).alias("k", "a")).select("episode", "frame", F.col("k").cast("long").alias("k"), r6(F.get("a", F.lit(0))).alias("a0"), r6(F.get("a", F.lit(1))).alias("a1"))


CHUNK = f"""with {FRAMES}, c as (select a.episode, a.frame, g.k as j, f.value, f.k as k2, a.value as s0, a.k as s1 from frames a cross join generate_series(0, 3) g(k) join frames f on f.episode = a.episode and f.frame = least(a.frame + g.k * 3, a.n - 1))"""


@query(f"{CHUNK} select episode, frame, cast(j as bigint) as k, round(value - s0, 6) as a0, round(k2 - s1, 6) as a1 from c")
def rel_actions(spark, d):
    df, sp = _chunks(spark, d, "rel")
    return _exploded(df, space.to_train(F.col("chunk"), F.col("state"), sp, 2))


@query(f"{CHUNK} select episode, frame, cast(j as bigint) as k, round(value - coalesce(lag(value) over w, s0), 6) as a0, round(k2 - coalesce(lag(k2) over w, s1), 6) as a1 from c window w as (partition by episode, frame order by j)")
def delta_actions(spark, d):
    df, sp = _chunks(spark, d, "delta")
    return _exploded(df, space.to_train(F.col("chunk"), F.col("state"), sp, 2))


ABSOLUTE = f"{CHUNK} select episode, frame, cast(j as bigint) as k, round(value, 6) as a0, round(k2, 6) as a1 from c"


@query(ABSOLUTE)
def rel_inverse(spark, d):
    df, sp = _chunks(spark, d, "rel")
    return _exploded(df, space.from_train(space.to_train(F.col("chunk"), F.col("state"), sp, 2), F.col("state"), sp, 2))


@query(ABSOLUTE)
def delta_inverse(spark, d):
    df, sp = _chunks(spark, d, "delta")
    return _exploded(df, space.from_train(space.to_train(F.col("chunk"), F.col("state"), sp, 2), F.col("state"), sp, 2))


# normalization

RANGES = "q as (select dim, quantile_cont(value, 0.01) as lo, quantile_cont(value, 0.99) as hi, min(value) as mi, max(value) as ma from cells group by dim)"


def _scaled(spark, d, mask=None):
    c = cells(spark, d)
    q = stats.quantiles(c, ["dim"], {"q01": 0.01, "q99": 0.99})
    return c.join(q, "dim"), (F.lit(True) if mask is None else F.col("dim").isin(mask))


@query(f"with {CELLS}, {RANGES} select episode, frame, c.dim, round((value - lo) / (hi - lo + 1e-6) * 2 - 1, 6) as value from cells c join q on q.dim = c.dim")
def normalize(spark, d):
    df, on = _scaled(spark, d)
    return df.select("episode", "frame", "dim", r6(stats.normalize(F.col("value"), F.col("q01"), F.col("q99"), on)).alias("value"))


@query(f"with {CELLS} select episode, frame, dim, round(value, 6) as value from cells")
def unnormalize(spark, d):
    df, on = _scaled(spark, d)
    y = stats.normalize(F.col("value"), F.col("q01"), F.col("q99"), on)
    return df.select("episode", "frame", "dim", r6(stats.unnormalize(y, F.col("q01"), F.col("q99"), on)).alias("value"))


@query(f"with {CELLS}, {RANGES} select episode, frame, c.dim, round(case when c.dim in (0, 2) then (value - lo) / (hi - lo + 1e-6) * 2 - 1 else value end, 6) as value from cells c join q on q.dim = c.dim")
def masked_normalize(spark, d):
    df, on = _scaled(spark, d, [0, 2])
    return df.select("episode", "frame", "dim", r6(stats.normalize(F.col("value"), F.col("q01"), F.col("q99"), on)).alias("value"))


@query(f"""with {CELLS}, x as (select episode, frame, dim, case dim when 0 then 5.0 when 1 then (case when value > 100000 then 1.0 else 0.0 end) else value end as value from cells),
  q as (select dim, quantile_cont(value, 0.01) as a, quantile_cont(value, 0.99) as z, min(value) as mi, max(value) as ma from x group by dim),
  b as (select dim, case when z - a <= 1e-6 then (case when ma - mi <= 1e-6 then mi - 0.5 else mi end) else a end as lo, case when z - a <= 1e-6 then (case when ma - mi <= 1e-6 then ma + 0.5 else ma end) else z end as hi from q)
  select episode, frame, x.dim, round((value - lo) / (hi - lo + 1e-6) * 2 - 1, 6) as value from x join b on b.dim = x.dim""")
def normalize_degenerate(spark, d):
    x = cells(spark, d).withColumn("value", F.when(F.col("dim") == 0, 5.0).when(F.col("dim") == 1, F.when(F.col("value") > 100000, 1.0).otherwise(0.0)).otherwise(F.col("value")))
    q = stats.quantiles(x, ["dim"], {"q01": 0.01, "q99": 0.99}).join(stats.moments(x, ["dim"]).select("dim", "min", "max"), "dim").withColumn("quantile_fallback", F.lit(1))
    lo, hi = stats.bounds()
    return x.join(q, "dim").select("episode", "frame", "dim", r6(stats.normalize(F.col("value"), lo, hi)).alias("value"))


# geometry


@query(f"""with {VECTORS}, u as (select vec_id, sqrt(v[1]^2 + v[2]^2 + v[3]^2) as n, v from vectors), a as (select vec_id, v[1] / n as a1, v[2] / n as a2, v[3] / n as a3, v from u),
  r as (select *, a1 * v[4] + a2 * v[5] + a3 * v[6] as dt from a), s as (select *, v[4] - dt * a1 as r1, v[5] - dt * a2 as r2, v[6] - dt * a3 as r3 from r), t as (select *, sqrt(r1^2 + r2^2 + r3^2) as m from s),
  b as (select vec_id, a1, a2, a3, r1 / m as b1, r2 / m as b2, r3 / m as b3 from t)
  select vec_id, round(a1, 6) as m00, round(a2, 6) as m01, round(b1, 6) as m10, round(a2 * b3 - a3 * b2, 6) as m20, round(a3 * b1 - a1 * b3, 6) as m21, round(a1 * b2 - a2 * b1, 6) as m22 from b""")
def rot6d_gram_schmidt(spark, d):
    m = vectors(spark, d).select("vec_id", geometry.rot6d_matrix_columns(F.slice("v", 1, 6)).alias("m"))
    return m.select("vec_id", *[r6(F.get("m", F.lit(i))).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "m10"), (6, "m20"), (7, "m21"), (8, "m22"))])


@query(f"""with {VECTORS}, q as (select vec_id, sqrt(v[1]^2 + v[2]^2 + v[3]^2 + v[4]^2) as n, v from vectors), u as (select vec_id, v[1] / n as x, v[2] / n as y, v[3] / n as z, v[4] / n as w from q)
  select vec_id, round(1 - 2 * (y * y + z * z), 6) as m00, round(2 * (x * y - w * z), 6) as m01, round(2 * (x * z + w * y), 6) as m02, round(2 * (y * z - w * x), 6) as m12, round(1 - 2 * (x * x + y * y), 6) as m22 from u""")
def quat_to_matrix(spark, d):
    m = vectors(spark, d).select("vec_id", geometry.quat_matrix_columns(F.slice("v", 1, 4)).alias("m"))
    return m.select("vec_id", *[r6(F.get("m", F.lit(i))).alias(n) for i, n in ((0, "m00"), (1, "m01"), (2, "m02"), (5, "m12"), (8, "m22"))])


@query(f"""with {VECTORS}, u as (select vec_id, v, cos(v[1]) as c, sin(v[1]) as s from vectors)
  select vec_id, round(c, 6) as m00, round(s, 6) as m01, round(-(c * v[2] + s * v[3]), 6) as x, round(s * v[2] - c * v[3], 6) as y, round(-v[4], 6) as z from u""")
def se3_inverse(spark, d):
    c, s = F.cos(F.get("v", F.lit(0))), F.sin(F.get("v", F.lit(0)))
    zero, one = F.lit(0.0), F.lit(1.0)
    m = vectors(spark, d).select("vec_id", geometry.inverse_columns(F.array(c, -s, zero, s, c, zero, zero, zero, one), F.slice("v", 2, 3)).alias("m"))
    return m.select("vec_id", *[r6(F.get("m", F.lit(i))).alias(n) for i, n in ((0, "m00"), (1, "m01"), (3, "x"), (7, "y"), (11, "z"))])


@query(f"""with {VECTORS}, p as (select a.vec_id, a.v, b.v as r from vectors a join vectors b on b.episode = a.episode and b.frame = 0)
  select vec_id, round(cos(r[3]) * (v[1] - r[1]) + sin(r[3]) * (v[2] - r[2]), 6) as x, round(-sin(r[3]) * (v[1] - r[1]) + cos(r[3]) * (v[2] - r[2]), 6) as y, round(v[3] - r[3], 6) as turn from p""")
def pose_relative(spark, d):
    """Poses in the plane (x, y, turn about z) relative to the first of their episode."""
    zero = F.lit(0.0)
    pose = lambda c: F.array(F.get(c, F.lit(0)), F.get(c, F.lit(1)), zero, zero, zero, F.get(c, F.lit(2)))
    v = vectors(spark, d)
    first = v.filter("frame = 0").select("episode", F.col("v").alias("r"))
    got = v.join(first, "episode").select("vec_id", geometry.pose_udf("relative", "xyz_rotvec")(pose("v"), pose("r")).alias("p"))
    return got.select("vec_id", r6(F.get("p", F.lit(0))).alias("x"), r6(F.get("p", F.lit(1))).alias("y"), r6(F.get("p", F.lit(5))).alias("turn"))


@query(f"""with {VECTORS}, u as (select vec_id, v[1] as x, v[2] as y, v[3] as z, v[4] as a, v[5] as b, v[6] as c, greatest(sqrt(v[4]^2 + v[5]^2 + v[6]^2), 1e-12) as t from vectors),
  h as (select *, case when cos(t / 2) < 0 then -1 else 1 end as f, sin(t / 2) / t as s, 1 - cos(t) as o, sin(t) as n, cos(t) as m, a / t as i, b / t as j, c / t as k from u),
  p as (select vec_id, 'xyz_quat' as format, [x, y, z, f * s * a, f * s * b, f * s * c, f * cos(t / 2)] as p from h
    union all select vec_id, 'xyz_rot6d', [x, y, z, m + i * i * o, i * j * o - k * n, i * k * o + j * n, j * i * o + k * n, m + j * j * o, j * k * o - i * n] from h)
  select vec_id, format, cast(unnest(generate_series(0, len(p) - 1)) as integer) as dim, round(unnest(p), 6) as value from p""")
def pose_formats(spark, d):
    """Each vector's pose as quaternion and as two rows of its rotation, one row per format and dim."""
    v = vectors(spark, d).select("vec_id", F.slice("v", 1, 6).alias("p"))
    out = None
    for fmt in ("xyz_quat", "xyz_rot6d"):
        part = v.select("vec_id", F.lit(fmt).alias("format"), F.posexplode(geometry.pose_udf("convert", "xyz_rotvec", fmt)("p")).alias("dim", "value"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("value", r6("value"))


@query()
def fk_arms(spark, d):
    """Tool poses of every vector's first joints by each kind of arm."""
    v = vectors(spark, d)
    out = None
    for name, n, side in (("aloha", 6, ""), ("franka", 7, ""), ("galaxea", 6, ""), ("agibot", 7, "left"), ("agibot", 7, "right")):
        part = v.select("vec_id", F.lit(f"{name}{side}").alias("arm"), geometry.fk_udf(name, side)(F.slice("v", 1, n)).alias("pose"))
        out = part if out is None else out.unionByName(part)
    return out.select("vec_id", "arm", F.posexplode("pose").alias("dim", "value"))


# mixtures, orders, splits


@query("select doc_id, coalesce(source, 'none') as source, cast(case when coalesce(source, 'none') < 'm' then 2.0 else 1.0 end as double) as weight from documents")
def mixture_concat(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("s"))
    names = sorted(r[0] for r in docs.select("s").distinct().collect())
    return sampling.mixture([(n, 2.0 if n < "m" else 1.0, docs.filter(F.col("s") == n).drop("s")) for n in names])


@query("""with s as (select source, count(*) as n, cast(case when source < 'm' then 2.0 else 1.0 end as double) as w from documents where source is not null group by source) select source, round(w * n / sum(w * n) over (), 6) as share from s""")
def mixture_share(spark, d):
    s = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.when(F.col("source") < "m", 2.0).otherwise(1.0))
    return sampling.shares(s, "source", "w", "n").select("source", r6("share").alias("share"))


@query("""with o as (select event_id, row_number() over (order by md5('7:0:' || event_id), event_id) - 1 as pos, count(*) over () as total from events)
  select event_id, cast(pos as bigint) as pos, cast(pos // 64 as bigint) as batch, cast((pos % 64) // 16 as bigint) as rank, cast(pos % 16 as bigint) as slot from o where pos // 64 >= 2 and pos // 64 < total // 64""")
def shuffle_cursor_batches(spark, d):
    e = table(spark, d, "events").select("event_id")
    return sampling.cursor_batches(sampling.shuffled(e, ["event_id"], 7), 16, 4, e.count(), start=2).select("event_id", "pos", "batch", "rank", "slot")


@query("""with o as (select event_id, row_number() over (order by event_id) - 1 as pos, count(*) over () as total from events),
  s as (select i as slot, least(i, total - 1) as pos, i < total as valid from (select max(total) as total from o) t, lateral (select unnest(generate_series(0, cast(ceil(total / 7.0) * 7 - 1 as bigint))) as i) g)
  select event_id, cast(slot % 7 as bigint) as rank, cast(slot // 7 as bigint) as step, valid from s join o on o.pos = s.pos""")
def rank_partition(spark, d):
    e = table(spark, d, "events").select("event_id").withColumn("_one", F.lit(1).cast("long"))
    ordered = temporal.sample_index(e, ["event_id"], "_one").select("event_id", F.col("start").alias("pos"))
    return sampling.rank_slices(ordered, 7, e.count()).select("event_id", "rank", "step", "valid")


def _uniform_sql(*keys: str) -> str:
    return f"cast(('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 13)) as bigint) / 4503599627370496.0"


@query(f"""with s as (select event_type as source, count(*) as n, cast(case when event_type < 'd' then 3.0 else 1.0 end as double) as w from events group by event_type),
  c as (select source, n, sum(w * n) over (order by source) / sum(w * n) over () as hi, (sum(w * n) over (order by source) - w * n) / sum(w * n) over () as lo from s),
  u as (select i as pos, {_uniform_sql("'5'", "'0'", "'source'", "i")} as u, {_uniform_sql("'5'", "'0'", "'row'", "i")} as v from generate_series(0, 19999) g(i))
  select cast(pos as bigint) as pos, source, cast(least(floor(v * n), n - 1) as bigint) as row from u join c on u >= lo and u < hi""")
def weighted_sample(spark, d):
    s = table(spark, d, "events").groupBy("event_type").count().orderBy("event_type").collect()  # a row per source
    return sampling.weighted_draws(spark, [(r[0], 3.0 if r[0] < "d" else 1.0, r[1]) for r in s], 20000, 5)


HELD = "g as (select o_custkey, row_number() over (order by md5('3:' || o_custkey)) as r, count(*) over () as total from (select distinct o_custkey from orders)), h as (select o_custkey, r <= least(total - 1, greatest(1, cast(floor(total * 0.2) as bigint))) as held from g)"


@query(f"with {HELD} select o_orderkey, held from orders join h on h.o_custkey = orders.o_custkey")
def holdout_grouped(spark, d):
    return sampling.holdout(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2, 3).select("o_orderkey", "held")


@query(f"with {HELD} select cast(count(*) as bigint) as groups from (select o_custkey from h where held intersect select o_custkey from h where not held)")
def holdout_overlap_zero(spark, d):
    s = sampling.holdout(table(spark, d, "orders").select("o_custkey"), "o_custkey", 0.2, 3)
    return sampling.overlap(s.filter("held"), s.filter("not held"), "o_custkey").agg(F.count(F.lit(1)).alias("groups"))


@query("""with e as (select user_id as episode, count(*) as n from events group by 1), lv as (select e.episode, n, g.k, row_number() over (order by g.k, e.episode) as r from e, lateral (select unnest(generate_series(1, n)) as k) g),
  q as (select episode, n, count(*) as c from lv where r <= 1000 group by 1, 2)
  select episode, cast(case when c = 1 then 0 else floor(i * (n - 1) / (c - 1.0) + 1e-12) end as bigint) as frame from q, lateral (select unnest(generate_series(0, c - 1)) as i) g""")
def balanced_validation(spark, d):
    e = frames(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    return sampling.balanced_sample(e, "episode", "n", 1000)


@query("""with s as (select source, row_number() over (order by source) - 1 as i, count(*) over () as k from (select distinct source from documents where source is not null)) select source, cast(103 // k + case when i < 103 % k then 1 else 0 end as bigint) as budget from s""")
def validation_budget(spark, d):
    names = sorted(r[0] for r in table(spark, d, "documents").filter("source is not null").select("source").distinct().collect())
    return spark.createDataFrame(list(sampling.budgets(names, 103).items()), "source string, budget long")


# batches


def _ragged(spark, d):
    """Chunks of up to twelve steps that end with their episode, one batch per episode."""
    got = temporal.gather_join(frames(spark, d), ["episode"], list(range(12)), ["value"]).filter("src = frame + k")
    e = got.groupBy("episode", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("a"))
    return e.withColumn("batch", F.col("episode"))


RAGGED = f"""{FRAMES}, x as (select episode, frame, episode as batch, least(12, n) as size, least(12, n - frame) as len, i from frames, lateral (select unnest(generate_series(0, least(12, n) - 1)) as i) g)"""


def _padded(df):
    return df.select("episode", "frame", "batch", F.posexplode(F.arrays_zip("a", "a_mask")).alias("pos", "x")).select("episode", "frame", "batch", F.col("pos").cast("long").alias("pos"), F.col("x.a").alias("value"), F.col("x.a_mask").alias("mask"))


@query(f"with {RAGGED} select x.episode, x.frame, x.batch, cast(i as bigint) as pos, coalesce(f.value, 0) as value, i < len as mask from x left join frames f on f.episode = x.episode and f.frame = x.frame + i and i < len")
def pad_actions(spark, d):
    return _padded(batching.pad_batches(_ragged(spark, d), "batch", ["a"]))


@query(f"with {RAGGED} select x.episode, x.frame, x.batch, cast(i as bigint) as pos, coalesce(f.value, 0) as value, i >= size - len as mask from x left join frames f on f.episode = x.episode and f.frame = x.frame + i - (size - len) and i >= size - len")
def pad_history_right(spark, d):
    return _padded(batching.pad_batches(_ragged(spark, d), "batch", [], ["a"]))


@query("""with c as (select coalesce(source, 'none') as camera, min(doc_id) as f from documents group by 1) select camera, cast(row_number() over (order by f, camera) - 1 as bigint) as position from c""")
def camera_union(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("camera"), "doc_id")
    return batching.camera_union(docs, "camera", ["doc_id"]).select("camera", "position")


CAMS = ["click", "error", "purchase", "signup", "view", "wrist"]


@query("""with e as (select user_id as episode, event_type as camera, max(value) as value from events group by 1, 2 having count(*) > 8)
  select u.episode, c.camera, cast(c.position as bigint) as position, e.value, e.value is not null as present from (select distinct episode from e) u cross join (values ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4), ('wrist', 5)) c(camera, position) left join e on e.episode = u.episode and e.camera = c.camera""")
def camera_mask(spark, d):
    """A camera is there where it has more than eight images of the episode."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("episode"), F.col("event_type").alias("camera")).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n")).filter("n > 8")
    return joins.align_cameras(e, ["episode"], "camera", "value", CAMS)


@query(f"select n_nationkey, cast(coalesce(t.id, 31) as bigint) as id from (select n_nationkey, case n_nationkey % 5 when 0 then 'aloha' when 1 then 'franka' when 2 then 'abc' when 3 then 'unheard' end as tag from nation) n left join (values {', '.join(f'({k!r}, {v})' for k, v in EMBODIMENT_IDS.items())}) t(tag, id) on t.tag = n.tag")
def embodiment_lookup(spark, d):
    k = F.col("n_nationkey") % 5
    rows = table(spark, d, "nation").select("n_nationkey", F.when(k == 0, "aloha").when(k == 1, "franka").when(k == 2, "abc").when(k == 3, "unheard").alias("tag"))
    ids = spark.createDataFrame([(t, i) for t, i in EMBODIMENT_IDS.items()], "tag string, id long")
    return joins.lookup(rows, ids, "tag", "id", F.lit(31).cast("long")).select("n_nationkey", "id")


@query("""with k as (select source, row_number() over (order by source nulls first) - 1 as repo from (select distinct source from documents)) select doc_id, cast(repo as bigint) as repo from documents join k on k.source is not distinct from documents.source""")
def repo_intern(spark, d):
    rows, _ = joins.intern(table(spark, d, "documents").select("doc_id", "source"), "source", "repo")
    return rows.select("doc_id", "repo")


# caches

PACKS = "packs as (select doc_id, coalesce(source, 'none') as pack, cast(coalesce(length(text), 0) + 1 as bigint) as length from documents)"


def _packs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("pack"), (F.coalesce(F.char_length("text"), F.lit(0)) + 1).cast("long").alias("length"))
    return caches.pack_offsets(docs, ["pack"], ["doc_id"], "length")


@query(f"""with {PACKS} select doc_id, pack, length, cast(sum(length) over (partition by pack order by doc_id) - length as bigint) as "offset" from packs""")
def pack_offsets(spark, d):
    return _packs(spark, d).select("doc_id", "pack", "length", "offset")


@query(f"""with {PACKS}, o as (select *, sum(length) over (partition by pack order by doc_id) - length as off from packs), k as (select * from o where length > 1), g as (select pack, off, length, coalesce(lag(off) over w + lag(length) over w, 0) as want from k window w as (partition by pack order by off)), s as (select pack, cast(sum(length) as bigint) as size from packs group by pack)
  select g.pack, cast(count(*) filter (where off <> want) as bigint) as gaps, cast(sum(length) as bigint) as total, max(size) as size from g join s on s.pack = g.pack group by g.pack having count(*) filter (where off <> want) > 0 or sum(length) <> max(size)""")
def pack_offsets_check(spark, d):
    """Packs that lost the entries of null and empty texts (the fault to find)."""
    whole = _packs(spark, d)
    sizes = whole.groupBy("pack").agg(F.sum("length").alias("size"))
    return caches.pack_faults(whole.filter("length > 1"), ["pack"], sizes).select("pack", "gaps", "total", "size")


@query(f"""with {PACKS}, f as (select *, row_number() over (partition by pack order by doc_id) - 1 as frame from packs), l as (select pack, max(frame) as last from f group by pack),
  w as (select l.pack, i * 17 as want, greatest(least(i * 17, last), 0) as src from l, generate_series(0, 9) g(i)) select w.pack, cast(want as bigint) as want, cast(src as bigint) as src, doc_id from w join f on f.pack = w.pack and f.frame = w.src""")
def pack_gather(spark, d):
    index = temporal.numbered(_packs(spark, d), ["pack"], ["doc_id"])
    wanted = index.select("pack").distinct().withColumn("want", F.explode(F.array(*[F.lit(i * 17).cast("long") for i in range(10)])))
    return caches.pack_gather(wanted, index, ["pack"], "want", "frame", ["doc_id"]).select("pack", "want", "src", "doc_id")


@query("select event_id, cast(event_id // 1024 as bigint) as shard from events")
def shard_plan(spark, d):
    return caches.shard_plan(table(spark, d, "events").select("event_id"), "event_id", 1024)


@query("select cast(event_id // 1024 as bigint) as shard, cast(count(*) as bigint) as rows from events where (event_id // 1024) % 3 <> 0 group by 1")
def shard_pending(spark, d):
    planned = caches.shard_plan(table(spark, d, "events").select("event_id"), "event_id", 1024)
    done = planned.filter("shard % 3 = 0").select("shard").distinct()  # the shards that are written
    return caches.pending(planned, done, ["shard"]).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


STARTS = "shards as (select user_id as shard, sum(count(*)) over (order by user_id) - count(*) as start, sum(count(*)) over (order by user_id) as stop from events group by user_id)"


@query(f"with {STARTS} select cast(e.event_id as bigint) as event_id, shard, cast((e.event_id * 7919) % t.n - start as bigint) as place from events e, (select count(*) as n from events) t join shards on (e.event_id * 7919) % t.n >= start and (e.event_id * 7919) % t.n < stop".replace("from events e, (select count(*) as n from events) t join", "from events e cross join (select count(*) as n from events) t join"))
def shard_lookup(spark, d):
    e = table(spark, d, "events")
    shards = temporal.sample_index(e.groupBy(F.col("user_id").alias("shard")).agg(F.count(F.lit(1)).alias("n")), ["shard"]).select("shard", "start", "stop")
    wanted = e.select("event_id", F.pmod(F.col("event_id") * 7919, F.lit(e.count())).alias("row"))
    return caches.shard_lookup(wanted, shards, "row").select("event_id", "shard", "place")


@query("""with s as (select coalesce(source, 'none') as source, count(*) as n from documents group by 1), r as (select source, sum(n) over (order by source) - n as start, sum(n) over (order by source) as stop, sum(n) over () as total from s),
  b as (select source, case when source = (select max(source) from s) then start + 1 else start end as start, stop, total from r), c as (select *, coalesce(lag(stop) over (order by start, stop), 0) as want, lead(start) over (order by start, stop) as nxt from b)
  select source, cast(start as bigint) as start, cast(stop as bigint) as stop from c where start <> want or (nxt is null and stop <> total) or stop < start""")
def source_ranges_tile(spark, d):
    """The last source's range, moved by one row (the fault to find)."""
    s = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    r = temporal.sample_index(s, ["source"])
    last = r.agg(F.max("source")).first()[0]
    moved = r.withColumn("start", F.when(F.col("source") == last, F.col("start") + 1).otherwise(F.col("start")))
    return caches.range_faults(moved.select("source", "start", "stop"), "start", "stop", r.agg(F.max("stop")).first()[0])


@query(f"""with {FRAMES}, s as (select episode, frame, n, us / 1e6 as t from frames), x as (select *, t - lag(t) over (partition by episode order by frame) as dt from s), m as (select episode, median(dt) as md, min(t) as t0, max(n) as n from x group by episode)
  select x.episode, x.frame, cast(greatest(least(coalesce(cast(round_even((t - t0) / md, 0) as bigint), 0), 39), 0) as bigint) as src from x join m on m.episode = x.episode where m.n <> 40 union all select x.episode, x.frame, x.frame from x join m on m.episode = x.episode where m.n = 40""")
def step_alignment(spark, d):
    f = frames(spark, d).withColumn("t", F.col("us") / 1e6)
    f = f.withColumn("t", F.col("t") - F.min("t").over(W.partitionBy("episode")))
    return caches.step_frames(f.select("episode", "frame", "t"), ["episode"], "t", F.lit(40)).select("episode", "frame", "src")


@query("""select coalesce(l_returnflag, 'all') as source, round(sum((l_extendedprice / 1000 - l_quantity) ** 2), 2) as error, cast(count(*) as bigint) as count, round(sum((l_extendedprice / 1000 - l_quantity) ** 2) / count(*), 6) as mse from lineitem where l_linestatus = 'O' group by rollup(l_returnflag)""")
def masked_mse_by_source(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("p"), "l_quantity", "l_linestatus")
    got = stats.masked_error(rows, "l_returnflag", "p", "l_quantity", F.col("l_linestatus") == "O").filter("count > 0")
    return got.select(F.coalesce("l_returnflag", F.lit("all")).alias("source"), F.round("error", 2).alias("error"), "count", r6("mse").alias("mse"))


@query("""with x as (select user_id as episode, sha256(concat_ws('|', event_id, event_type)) as d from events)
  select episode, sha256(cast(count(*) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 1, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 9, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 17, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 25, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 33, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 41, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 49, 8) as bigint)) as varchar) || ':' || cast(sum(cast('0x' || substr(d, 57, 8) as bigint)) as varchar)) as fingerprint from x group by episode""")
def fingerprint(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("episode"), "event_id", "event_type")
    return stats.fingerprint(e, ["episode"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))


# training math and codecs

NOISE = _uniform_sql("vec_id", "i")


@query(f"""with {VECTORS}, c as (select vec_id, i, v[i + 1] as x, {NOISE} as e, (vec_id % 10) / 10.0 as t from vectors, generate_series(0, 63) g(i)) select vec_id, cast(i as bigint) as dim, round(t * e + (1 - t) * x, 6) as x_t, round(e - x, 6) as u_t from c""")
def flow_xt(spark, d):
    c = vectors(spark, d).select("vec_id", F.posexplode("v").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long")).withColumn("e", space.uniform("vec_id", "dim")).withColumn("t", (F.col("vec_id") % 10) / 10.0)
    return c.select("vec_id", "dim", r6(flow.flow_point(F.col("x"), F.col("e"), F.col("t"))).alias("x_t"), r6(flow.flow_target(F.col("x"), F.col("e"))).alias("u_t"))


@query(f"""with {VECTORS}, c as (select episode, vec_id, i, v[i + 1] as x, {NOISE} as e from vectors, generate_series(0, 63) g(i)) select episode, round(sum((e - x) ** 2) / count(*), 6) as loss, cast(count(*) as bigint) as count from c where i < 1 + vec_id % 64 group by episode""")
def masked_flow_loss(spark, d):
    c = vectors(spark, d).select("episode", "vec_id", F.posexplode("v").alias("dim", "x")).withColumn("e", space.uniform("vec_id", "dim")).withColumn("pred", F.lit(0.0))
    got = flow.flow_loss(c, "episode", "pred", "x", "e", F.col("dim") < 1 + F.col("vec_id") % 64).filter("episode is not null and count > 0")
    return got.select("episode", r6("mse").alias("loss"), "count")


@query("""with o as (select cast(k as bigint) as k, -k / 10.0 as o from generate_series(0, 31) g(k)), f as (select cast(i as bigint) as i, pow(10000.0, -i / 8.0) as f from generate_series(0, 7) g(i)) select k, i, round(sin(o * f), 6) as s, round(cos(o * f) - 1, 6) as c from o cross join f""")
def time_features(spark, d):
    """Sine and cosine less one of relative times at eight frequencies."""
    o = spark.range(32).select(F.col("id").alias("k"), F.posexplode(flow.time_waves(-F.col("id") / 10.0, 8)).alias("i", "w"))
    return o.select("k", F.col("i").cast("long").alias("i"), r6("w.s").alias("s"), r6("w.c").alias("c"))


@query(f"""with {FRAMES} select episode, frame, cast(round_even(us % 100000000 / 1e6 * 25, 0) + frame as bigint) as src from frames""")
def v3_frame_offset(spark, d):
    f = frames(spark, d)
    return f.select("episode", "frame", (F.rint((F.col("us") % 100000000) / 1e6 * 25).cast("long") + F.col("frame")).alias("src"))


@query(f"""with {FRAMES}, s as (select user_id as episode, i * 10 as start, i * 10 + 7 as stop from (select distinct user_id from events), generate_series(0, 9) g(i)) select f.episode, f.frame, cast(s.start as bigint) as start from frames f join s on s.episode = f.episode and f.frame >= s.start and f.frame < s.stop""")
def frames_in_span(spark, d):
    f = frames(spark, d)
    spans = f.select("episode").distinct().withColumn("i", F.explode(F.array(*[F.lit(i).cast("long") for i in range(10)]))).select("episode", (F.col("i") * 10).alias("start"), (F.col("i") * 10 + 7).alias("stop"))
    return joins.interval_join(f, spans, ["episode"], "frame", width=32).select("episode", "frame", "start")


@query("""select doc_id, coalesce(source, 'none') as source, lang from documents qualify row_number() over (partition by coalesce(source, 'none'), lang order by doc_id) = 1""")
def streams_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), "lang")
    return caches.distinct_streams(docs, ["source", "lang"], ["doc_id"])


@query("select l_orderkey, l_linenumber, l_returnflag as source from lineitem")
def union_members(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    flags = sorted(r[0] for r in li.select("l_returnflag").distinct().collect())
    return sampling.mixture([(f, 1.0, li.filter(F.col("l_returnflag") == f).drop("l_returnflag")) for f in flags]).drop("weight")


@query(f"with {VECTORS} select vec_id, cast(i as bigint) as dim, round(case when i >= 4 and i < 8 then v[i + 29] when i >= 20 and i < 22 then 0 else v[i + 1] end, 6) as value from vectors, generate_series(0, 63) g(i)")
def splice_dims(spark, d):
    pieces = [(4, 8, F.slice("v", 33, 4)), (20, 22, space.zeros(2, "double"))]
    v = vectors(spark, d).select("vec_id", space.splice(F.col("v"), pieces, 64).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 2)")
def members_semi(spark, d):
    known = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(known, "c_nationkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def members_anti(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(f"with {FRAMES} select episode, frame, value from frames")
def current_state(spark, d):
    """The last step of each frame's history of four states."""
    past = temporal.gather_join(frames(spark, d), ["episode"], [-3, -2, -1, 0], ["value"])
    h = past.groupBy("episode", "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("h"))  # four each
    return h.select("episode", "frame", space.last_step(F.col("h")).alias("value"))


@query(f"""with {VECTORS} select vec_id, cast(i as bigint) as dim, round(case when {_uniform_sql("'9'", "vec_id")} < 0.3 then 0 else v[i + 1] end, 6) as value from vectors, generate_series(0, 63) g(i)""")
def state_mask(spark, d):
    v = vectors(spark, d).select("vec_id", space.masked_state(F.col("v"), 0.3, F.lit("9"), "vec_id").alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))


@query(f"""with {FRAMES}, {RUNS}, n as (select episode, max(n) as n from frames group by 1), b as (select r.episode, start, case when start % 5 = 0 then stop + 1 else stop end as stop, event_type, n from runs r join n on n.episode = r.episode),
  c as (select *, coalesce(lag(stop) over (partition by episode order by start, stop), 0) as before from b) select episode, cast(start as bigint) as start, cast(stop as bigint) as stop from c where start >= stop or start < 0 or stop > n or trim(event_type) = '' or before > start""")
def segments_invalid(spark, d):
    """Segments that were made longer where their start is a multiple of five (the fault to find)."""
    f = frames(spark, d)
    runs = temporal.run_segments(f, ["episode"], "event_type").join(f.groupBy("episode").agg(F.max("n").alias("n")), "episode")
    longer = runs.withColumn("stop", F.when(F.col("start") % 5 == 0, F.col("stop") + 1).otherwise(F.col("stop")))
    return temporal.segment_faults(longer, ["episode"], text="event_type").select("episode", "start", "stop")


@query("select episode, n from (select user_id as episode, cast(count(*) as bigint) as n from events group by 1) order by episode limit 20")
def episode_limit(spark, d):
    """The first 20 episodes: the limit is what the operator is for."""
    return frames(spark, d).groupBy("episode").agg(F.count(F.lit(1)).alias("n")).orderBy("episode").limit(20)


@query("""with c as (select cast(h as bigint) as h, cast(w as bigint) as w from generate_series(100, 700, 37) a(h) cross join generate_series(90, 900, 53) b(w)), s as (select h, w, 224.0 / greatest(h, w) as k from c), r as (select h, w, cast(greatest(1, round_even(h * k, 0)) as bigint) as nh, cast(greatest(1, round_even(w * k, 0)) as bigint) as nw from s)
  select h, w, nh, nw, cast((224 - nh) // 2 as bigint) as top, cast((224 - nw) // 2 as bigint) as "left" from r""")
def letterbox_size(spark, d):
    """Size and place of an image scaled into a square of 224."""
    sizes = spark.range(17).select((100 + F.col("id") * 37).alias("h")).select("h", F.explode(F.sequence(F.lit(90).cast("long"), F.lit(900).cast("long"), F.lit(53).cast("long"))).alias("w"))
    k = F.lit(224.0) / F.greatest("h", "w")
    r = sizes.select("h", "w", F.greatest(F.lit(1).cast("long"), F.rint(F.col("h") * k).cast("long")).alias("nh"), F.greatest(F.lit(1).cast("long"), F.rint(F.col("w") * k).cast("long")).alias("nw"))
    return r.withColumn("top", F.floor((224 - F.col("nh")) / 2)).withColumn("left", F.floor((224 - F.col("nw")) / 2))


@query(f"""with {FRAMES}, x as (select event_type, us - lag(us) over (partition by episode order by frame) as dt from frames), r as (select *, row_number() over (partition by event_type order by dt) - 1 as i, count(*) over (partition by event_type) as n from x where dt is not null)
  select event_type, round(avg(dt), 2) as mean, cast(max(n) as bigint) as n, cast(max(case when i = round_even((n - 1) * 0.5, 0) then dt end) as bigint) as p50, cast(max(case when i = round_even((n - 1) * 0.95, 0) then dt end) as bigint) as p95 from r group by event_type""")
def interval_percentiles(spark, d):
    w = W.partitionBy("episode").orderBy("frame")
    x = frames(spark, d).select("event_type", (F.col("us") - F.lag("us").over(w)).alias("dt"))
    return stats.nearest_rank(x, ["event_type"], "dt", {"p50": 0.5, "p95": 0.95}).withColumn("mean", F.round("mean", 2))


@query(f"""with {VECTORS}, c as (select a.episode, a.v[i + 1] as r, coalesce(b.v, a.v)[i + 1] as a from vectors a left join vectors b on b.episode = a.episode and b.frame = a.frame + 1, generate_series(0, 63) g(i))
  select episode, round(sum((a - r) ** 2), 6) as error_sq, round(sum(r * r), 6) as reference_sq, round(sum(a * r), 6) as dot, round(max(abs(a - r)), 6) as max_abs, cast(count(*) as bigint) as count, round(sqrt(sum((a - r) ** 2) / sum(r * r)), 6) as relative_l2, round(sum(a * r) / sqrt(sum(r * r) * sum(a * a)), 6) as cosine from c group by episode""".replace("and b.frame = a.frame + 1, generate_series(0, 63) g(i))", "and b.frame = a.frame + 1 cross join generate_series(0, 63) g(i))"))
def parity_metrics(spark, d):
    w = W.partitionBy("episode").orderBy("frame")
    v = vectors(spark, d).withColumn("a", F.coalesce(F.lead("v").over(w), F.col("v")))
    c = v.select("episode", F.explode(F.arrays_zip(F.col("a").alias("a"), F.col("v").alias("r"))).alias("x")).select("episode", "x.a", "x.r")
    got = stats.parity(c, ["episode"], "a", "r")
    return got.select("episode", "count", *[r6(k).alias(k) for k in ("error_sq", "reference_sq", "dot", "max_abs", "relative_l2", "cosine")])


@query(f"""with {FRAMES} select a.episode, a.frame, cast(g.k as bigint) as k, f.value from frames a cross join generate_series(0, 3) g(k) join frames f on f.episode = a.episode and f.frame = greatest(a.frame + g.k - 3, 0)""")
def legacy_online_history(spark, d):
    """The last four observations; before the first one, the first again."""
    return temporal.gather_join(frames(spark, d), ["episode"], [-3, -2, -1, 0], ["value"]).select("episode", "frame", "k", "value")


@query(f"{CHUNK} select episode, frame, cast(j as bigint) as k, round(case when j < frame % 4 then s0 else value end, 6) as value from c")
def prefix_select(spark, d):
    """Chunks whose first steps are taken from a prefix."""
    f = frames(spark, d)
    own = f.select("episode", "frame", F.array_repeat("value", 4).alias("prefix"))
    got = temporal.gather(f, ["episode"], DELTAS, ["value"]).groupBy("episode", "frame").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("c"))
    chunk = got.join(own, ["episode", "frame"]).select("episode", "frame", flow.with_prefix(F.col("c.value"), F.col("prefix"), F.col("frame") % 4).alias("c"))
    return chunk.select("episode", "frame", F.posexplode("c").alias("k", "value")).select("episode", "frame", F.col("k").cast("long").alias("k"), r6("value").alias("value"))


# streams and wire


@query(SQL["history_timestamp"])
def stream_history_replay(spark, d):
    """The live history of every user's events, replayed as a stream from the table's file."""
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    obs = source.select(F.col("user_id").cast("string").alias("stream"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0).alias("ts"), "value", F.lit("episode").alias("context"))
    got = history.replayed(obs, 2.0, 2.0).filter("error is null")
    return got.select(F.col("stream").cast("long").alias("episode"), r6("now").alias("now"), "k", "valid", r6("offset").alias("offset"), "value")


@query(f"with {VECTORS} select vec_id, cast(i as bigint) as dim, round(v[i + 1], 6) as value from vectors, generate_series(0, 63) g(i)")
def codec_roundtrip(spark, d):
    v = vectors(spark, d).select("vec_id", wire.from_wire(wire.to_wire("v")).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6("value").alias("value"))

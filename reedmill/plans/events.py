"""Queries over the event table: curves, run summaries, feeds and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feeds, folds, sets
from ..session import small_side, table
from .registry import query


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
with c as (select user_id, cast(date_part('day', ts) as int) as step, avg(value) as v from events group by all)
select coalesce(a.step, b.step) as step, round(a.v, 6) as a, round(b.v, 6) as b, round(b.v - a.v, 6) as delta
from (select step, v from c where user_id = 1) a full join (select step, v from c where user_id = 2) b on a.step = b.step
""")
def curve_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Daily means of two users side by side."""
    days = _events(spark, d).where("user_id IN (1, 2)").groupBy("user_id", F.dayofmonth("ts").alias("step")).agg(F.avg("value").alias("v"))
    out = sets.full_outer_curve(days.where("user_id = 1"), days.where("user_id = 2"), "step", "v")
    return out.select("step", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")])


@query("""
with m as (select user_id, event_type as k, max(value) as v from events where user_id in (1, 2) group by all)
select coalesce(a.k, b.k) as key, a.v as a, b.v as b from (from m where user_id = 1) a full join (from m where user_id = 2) b on a.k = b.k where a.v is distinct from b.v
""")
def config_diff(spark: SparkSession, d: str) -> DataFrame:
    """Keys at which two users' maps differ."""
    m = table(spark, d, "events").where("user_id IN (1, 2)").groupBy("user_id", F.col("event_type").alias("key")).agg(F.max("value").alias("v"))
    a, b = m.where("user_id = 1").select("key", F.col("v").alias("a")), m.where("user_id = 2").select("key", F.col("v").alias("b"))
    return a.join(b, "key", "full").where(~F.col("a").eqNullSafe(F.col("b")))


@query("select user_id, event_type from (select distinct e.user_id, t.event_type from events e, (select distinct event_type from events) t) except select user_id, event_type from events where value > 20")
def missing_tags(spark: SparkSession, d: str) -> DataFrame:
    """Types of which a user has no large event."""
    e = table(spark, d, "events")
    every = e.select("user_id").distinct().crossJoin(small_side(e.select("event_type").distinct(), 1_000))
    return every.join(e.where("value > 20").select("user_id", "event_type"), ["user_id", "event_type"], "left_anti")


@query("""
select user_id, min(value) as best, arg_min(event_id, value * 10000000.0 + event_id) as best_step, arg_max(value, event_id) as last, max(event_id) as last_step, count(*) as steps from events group by user_id
""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Best value and its first step, last value, last step and number of steps of each run."""
    return table(spark, d, "events").groupBy("user_id").agg(
        F.min("value").alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("best_step"), F.max_by("value", "event_id").alias("last"),
        F.max("event_id").alias("last_step"), F.count("*").alias("steps"),
    )


@query("select event_type, user_id, value, event_id from events qualify row_number() over (partition by event_type order by value desc, event_id) = 1")
def best_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("neg", -F.col("event_id"))
    return feeds.keep_last(rows, ["event_type"], ["value", "neg"]).select("event_type", "user_id", "value", "event_id")


@query("select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return feeds.keep_last(_events(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def keep_last_per_key(spark: SparkSession, d: str) -> DataFrame:
    """What a consumer sees that drains its queue and keeps the last message of each kind."""
    return feeds.keep_last(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
with s as (select user_id, list({'best': value, 'step': event_id, 'stale': 0, 'stop': cast(null as bigint)} order by event_id) as l from events where value is not null group by user_id),
f as (select user_id, list_reduce(l, lambda a, x: case when a.stop is not null then a when x.best < a.best - 0.001 then x
  else {'best': a.best, 'step': a.step, 'stale': a.stale + 1, 'stop': case when a.stale + 1 >= 6 then x.step end} end) as r from s)
select user_id, r.best as best, r.step as best_step, r.stop as stopped_at from f
""")
def early_stop_fold(spark: SparkSession, d: str) -> DataFrame:
    """Where each user's series would stop at patience 6 and gain 0.001."""
    return folds.early_stops(table(spark, d, "events"), "user_id", "event_id", "value", 0.001, 6)


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


_LINE = "case when event_id % 7 = 0 then ' ' when event_id % 5 = 0 then event_type when event_id % 3 = 0 then event_type || chr(9) || 'soon' else event_type || chr(9) || cast(round(value) as int) end"


@query(f"""
with l as (select event_id, {_LINE} as line from events)
select event_id, trim(split_part(line, chr(9), 1)) as text, cast(coalesce(try_cast(nullif(split_part(line, chr(9), 2), '') as float), 4.0) as double) as secs from l where trim(split_part(line, chr(9), 1)) <> ''
""")
def bubble_feed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Feed lines made of the events: text and seconds, with missing and bad numbers and blank lines."""
    line = F.expr("case when event_id % 7 = 0 then ' ' when event_id % 5 = 0 then event_type when event_id % 3 = 0 then concat(event_type, '\\t', 'soon') else concat(event_type, '\\t', cast(cast(round(value) as int) as string)) end")
    said, secs = feeds.parse_bubble(line)
    return table(spark, d, "events").select("event_id", said.alias("text"), secs.cast("double").alias("secs")).where("text IS NOT NULL")


_JSON = """case event_id % 6 when 0 then '{"type": "SetStyle", "style": "Sitelen"}' when 1 then '{"type": "SetStyle", "style": "plaid"}' when 2 then '{"type": "Bubble", "text": "' || event_type || '", "secs": 2.5}'
 when 3 then '{"type": "Bubble", "text": " "}' when 4 then '{"type": "Force", "force": "flit"}' else '{broken' end"""


@query("select event_id, case event_id % 6 when 0 then 'SetStyle' when 2 then 'Bubble' else 'Force' end as kind, case event_id % 6 when 0 then 'Sitelen' when 2 then event_type else 'flit' end as what from events where event_id % 6 in (0, 2, 4)")
def control_feed_parse(spark: SparkSession, d: str) -> DataFrame:
    """Control messages made of the events; invalid JSON, blank bubbles and unknown styles are dropped."""
    rows = table(spark, d, "events").select("event_id", feeds.parse_control(F.expr(_JSON)).alias("m")).where("m IS NOT NULL")
    return rows.select("event_id", F.col("m.type").alias("kind"), F.coalesce("m.style", "m.text", "m.force").alias("what"))


@query("""
select event_id, user_id, epoch_us(least(ts + to_microseconds(cast(value * 1000000 as bigint)), coalesce(lead(ts) over (partition by user_id order by ts, event_id), timestamp '9999-01-01'))) as until_us from events
""")
def bubble_intervals(spark: SparkSession, d: str) -> DataFrame:
    """How long each message of a user stays: its value in seconds, or until the next."""
    out = feeds.shown_intervals(_events(spark, d), "user_id", "ts", F.col("value"), ["ts", "event_id"])
    return out.select("event_id", "user_id", F.unix_micros("shown_until").alias("until_us"))


@query("""
select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as k from events)
where k = 1 or before is distinct from event_type
""")
def focus_changes(spark: SparkSession, d: str) -> DataFrame:
    return feeds.changes(_events(spark, d), "user_id", "ts", ["event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("select user_id, event_id, value from events where event_type <> 'error' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1 and event_type <> 'signup'")
def active_window_state(spark: SparkSession, d: str) -> DataFrame:
    """The last visible window of each user; a signup event clears it."""
    last = feeds.keep_last(_events(spark, d).where("event_type <> 'error'"), ["user_id"], ["ts", "event_id"])
    return last.where("event_type <> 'signup'").select("user_id", "event_id", "value")


@query("""
select user_id, arg_max(value, event_id) filter (event_type = 'view') as title, arg_max(value, event_id) filter (event_type = 'click') as app, arg_max(value, event_id) filter (event_type = 'purchase') as place from events group by user_id
""")
def window_assembly(spark: SparkSession, d: str) -> DataFrame:
    """One row a window from partial events: the last known title, application and place."""
    part = lambda kind, name: F.when(F.col("event_type") == kind, F.col("value")).alias(name)
    rows = table(spark, d, "events").select("user_id", "event_id", part("view", "title"), part("click", "app"), part("purchase", "place"))
    return feeds.assembled(rows, "user_id", ["title", "app", "place"], F.col("event_id"))


@query("select event_id, cast(floor(value * 8) % 6 as bigint) as frame from events")
def anim_frame_index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", feeds.frame_index(F.col("value"), 8.0, 6).cast("long").alias("frame"))


@query("""
with r as (select event_id, cast(round(value) as int) as x, cast(user_id as int) as y from events)
select event_id, greatest(least(x - 20, y - 10), 0) as x0, greatest(least(y - 20, x - 10), 0) as y0, least(greatest(x + 20, y + 10), 120) as x1, least(greatest(y + 20, x + 10), 100) as y1 from r
""")
def rect_union_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Union of two rectangles, clamped to a surface of 120 x 100."""
    rows = table(spark, d, "events").select("event_id", F.round("value").cast("int").alias("x"), F.col("user_id").cast("int").alias("y"))
    x, y = F.col("x"), F.col("y")
    out = feeds.union_rect([x - 20, y - 20, x + 20, y + 20], [y - 10, x - 10, y + 10, x + 10], F.lit(120), F.lit(100))
    return rows.select("event_id", *[c.alias(n) for c, n in zip(out, ("x0", "y0", "x1", "y1"), strict=True)])


@query("""
select epoch_us(time_bucket(interval '6 hours', ts, timestamp '1970-01-01')) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by all
""")
def ext_window(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of six hours (an extension)."""
    out = _events(spark, d).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "total")


@query("""
with g as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '4 hours', true) as fresh from events),
s as (select *, count(*) filter (fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) + 14400000000 as end_us, count(*) as n from s group by user_id, session
""")
def ext_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after four quiet hours (an extension)."""
    out = _events(spark, d).groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")

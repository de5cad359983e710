"""Visitor analytics and health checks over events and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import months, numbers
from ridgeline.plans.growth import bound_items
from ridgeline.plans.registry import query
from ridgeline.sources import bindings as b

UNKNOWN = "미확인"
GAP = "30 minutes"


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Runs of a visitor's events without a longer gap; batch, or streaming after withWatermark()."""
    at = F.struct("ts", "event_id")
    found = events.groupBy("visitor_id", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"), F.count_if(F.col("event_name") == "view").alias("views"),
        F.min_by("event_name", at).alias("entry"), F.max_by("event_name", at).alias("exit"), F.bool_or(F.col("event_name") == "error").alias("failed"),
    )
    return found.drop("w")


GROUPED = "with g as (select *, case when ts - lag(ts) over (partition by visitor_id order by ts, event_id) <= interval 30 minute then 0 else 1 end as new from ev), s as (select *, sum(new) over (partition by visitor_id order by ts, event_id) as n from g) "


@query("t1_sessions", GROUPED + "select visitor_id, min(ts) as started_at, max(ts) as last_seen_at, cast(count(*) as bigint) as events, cast(count(*) filter (event_name = 'view') as bigint) as views, arg_min(event_name, (ts, event_id)) as entry, arg_max(event_name, (ts, event_id)) as exit, bool_or(event_name = 'error') as failed from s group by visitor_id, n")
def t1(spark, sf):
    found = sessions(b.events(spark, sf))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_seen_at")})


PATHS = "pathed as (select *, '/' || coalesce(cast(k as varchar), '') as path, event_name = 'purchase' as is_admin from ev), g as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as new from pathed window w as (partition by visitor_id order by ts, event_id)), s as (select *, sum(new) over (partition by visitor_id order by ts, event_id) as n from g)"


@query("t2_session_state", f"with {PATHS} select visitor_id, min(ts) as started_at, max(ts) as last_seen_at, cast(count(*) as bigint) as events, cast(count(*) filter (event_name = 'view') as bigint) as views, arg_min(path, (ts, event_id)) as entry_path, arg_max(path, (ts, event_id)) as exit_path, bool_or(is_admin) as is_admin from s group by visitor_id, n")
def t2(spark, sf):
    """The batch form of the sessions that streaming/states.py keeps: entry and exit path, an admin flag that stays."""
    from ridgeline.streaming.states import sessions_of

    e = b.events(spark, sf).withColumns({"path": F.concat(F.lit("/"), F.coalesce(F.col("k").cast("string"), F.lit(""))), "is_admin": F.col("event_name") == "purchase"})
    return sessions_of(e).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_seen_at")})


@query("t3_visitor_state", f"with {PATHS} select visitor_id, min(ts) as first_seen_at, max(ts) as last_seen_at, cast(count(*) as bigint) as events, cast(count(*) filter (event_name = 'view') as bigint) as views, arg_max(event_name, (ts, event_id)) as last_event, arg_max(path, (ts, event_id)) as last_path, arg_max(is_admin, (ts, event_id)) as is_admin, bool_or(is_admin) as was_admin from pathed group by 1")
def t3(spark, sf):
    """The batch form of the visitors that streaming/states.py keeps, with their last values."""
    from ridgeline.streaming.states import visitors_of

    e = b.events(spark, sf).withColumns({"path": F.concat(F.lit("/"), F.coalesce(F.col("k").cast("string"), F.lit(""))), "is_admin": F.col("event_name") == "purchase"})
    return visitors_of(e).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")})


def visitors(events: DataFrame) -> DataFrame:
    at = F.struct("ts", "event_id")
    return events.groupBy("visitor_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("events"), F.count_if(F.col("event_name") == "view").alias("views"), F.max_by("event_name", at).alias("last_event"), F.max_by("k", at).alias("last_k"), F.bool_or(F.col("event_name") == "purchase").alias("bought"))


VISITORS = "visitors as (select visitor_id, min(ts) as first_seen_at, max(ts) as last_seen_at, cast(count(*) as bigint) as events, cast(count(*) filter (event_name = 'view') as bigint) as views, arg_max(event_name, (ts, event_id)) as last_event, arg_max(k, (ts, event_id)) as last_k, bool_or(event_name = 'purchase') as bought from ev group by 1)"


@query("a13_visitor_rollup", f"with {VISITORS} select * from visitors")
def a13(spark, sf):
    v = visitors(b.events(spark, sf))
    return v.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")})


def top_by(events: DataFrame, label: Column, n: int) -> DataFrame:
    """Labels by visitors, then events, then newest sight."""
    g = events.groupBy(F.coalesce(label, F.lit(UNKNOWN)).alias("label")).agg(F.countDistinct("visitor_id").alias("visitors"), F.count("*").alias("events"), F.max("ts").alias("seen"))
    return g.orderBy(F.col("visitors").desc(), F.col("events").desc(), F.col("seen").desc(), "label").limit(n).select("label", "visitors", "events")


@query("a12_top_labels", f"select coalesce(nullif(cast(k as varchar), '0'), '{UNKNOWN}') as label, cast(count(distinct visitor_id) as bigint) as visitors, cast(count(*) as bigint) as events from ev group by 1 order by visitors desc, events desc, max(ts) desc, label limit 20")
def a12(spark, sf):
    return top_by(b.events(spark, sf), F.nullif(F.col("k").cast("string"), F.lit("0")), 20)


@query("a11_daily", "select cast(ts as date) as day, cast(count(*) as bigint) as events, cast(count(distinct visitor_id) as bigint) as visitors from ev group by 1 order by 1 desc limit 31")
def a11(spark, sf):
    return b.events(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"), F.countDistinct("visitor_id").alias("visitors")).orderBy(F.col("day").desc()).limit(31)


@query("a14_horizons", "with n as (select max(ts) as t from ev) select " + ", ".join(f"cast(count(distinct visitor_id) filter ({w}) as bigint) as visitors_{h}, cast(count(*) filter ({w} and event_name = 'view') as bigint) as views_{h}" for h, w in (("30m", "ts >= t - interval 30 minute"), ("day", "cast(ts as date) = cast(t as date)"), ("7d", "ts >= t - interval 7 day"), ("all", "true"))) + " from ev, n")
def a14(spark, sf):
    """All horizons in one pass; now is the newest event, one row that is read first."""
    e = b.events(spark, sf)
    now = e.agg(F.max("ts").alias("t")).scalar()
    e = e.withColumn("t", now)
    spans = {"30m": F.expr("ts >= t - interval 30 minutes"), "day": F.to_date("ts") == F.to_date("t"), "7d": F.expr("ts >= t - interval 7 days"), "all": F.lit(True)}
    aggs = []
    for h, w in spans.items():
        aggs += [F.countDistinct(F.when(w, F.col("visitor_id"))).alias(f"visitors_{h}"), F.count_if(w & (F.col("event_name") == "view")).alias(f"views_{h}")]
    return e.agg(*aggs)


@query("j23_events_with_visitors", f"with {VISITORS} select event_name, cast(count(*) as bigint) as n from ev join visitors using (visitor_id) where bought and ev.ts > visitors.first_seen_at group by 1")
def j23(spark, sf):
    e = b.events(spark, sf)
    v = visitors(e).where("bought").select("visitor_id", "first_seen_at")
    return e.join(v, "visitor_id").where("ts > first_seen_at").groupBy("event_name").agg(F.count("*").alias("n"))


@query("t6_throttle", "with recursive f as (select event_name, min(ts) as ts from ev where event_name in ('error', 'purchase') group by 1 union all select f.event_name, (select min(e.ts) from ev e where e.event_name = f.event_name and e.ts >= f.ts + interval 6 hour) from f where f.ts is not null) select event_name, ts from f where ts is not null".replace("with recursive", "with"))
def t6(spark, sf):
    """Alerts: per key the first, then each first one at least six hours after the last alert."""
    e = b.events(spark, sf).where(F.col("event_name").isin("error", "purchase"))
    from ridgeline.streaming.visitors import throttled

    return throttled(e, "event_name", 6 * 3600).select("event_name", F.col("ts").cast("timestamp_ntz").alias("ts"))


# Metadata of events

def described(spark, sf) -> DataFrame:
    """Events with metadata made of their number k: nested objects, lists and texts, some beyond the bounds."""
    k = F.coalesce("k", F.lit(0))
    deep = F.concat(F.lit('{"a":{"b":['), k.cast("string"), F.lit(',true,null],"n":'), k.cast("string"), F.lit(".5}}"))
    words = F.array_join(F.transform(F.sequence(F.lit(0), k % 30), lambda i: F.concat(F.lit('"'), i.cast("string"), F.repeat(F.lit("w"), k * 3), F.lit('"'))), ",")
    text = F.concat(F.lit('{"deep":'), deep, F.lit(',"name":"'), F.repeat(F.lit("n"), k * 10), F.lit('","words":['), words, F.lit("]}"))
    shown = F.when(k % 13 == 0, F.lit("[1, 2]")).when(k % 17 == 0, F.lit("no json")).otherwise(text)
    # The texts are far larger than the events they are made of: dealt out first, so that a small file isn't one task.
    return b.events(spark, sf).select("event_id", "visitor_id", "k").repartition(2 * spark.sparkContext.defaultParallelism).select("event_id", "visitor_id", k.alias("k"), shown.alias("metadata"))


BOUNDED = """with m as (select event_id, visitor_id, coalesce(k, 0) as k from ev), w as (select *, array_to_string(list_transform(range(0, least(k % 30 + 1, 20)), lambda i: '"' || left(i || repeat('w', k * 3), 500) || '"'), ',') as words from m),
j as (select *, '{"deep":{"a":{"b":[' || k || ',true,null],"n":' || k || '.5}},"name":"' || left(repeat('n', k * 10), 500) || '","words":[' || words || ']}' as text from w),
s as (select event_id, visitor_id, k, case when k % 13 = 0 or k % 17 = 0 then '{}' when length(text) > 4000 then '{"truncated":true}' else text end as metadata from j)"""


@query("f22_metadata", f"{BOUNDED} select event_id, cast(length(metadata) as int) as size, sha256(metadata) as digest, metadata = '{{{{}}}}' as bare from s".replace("{{}}", "{}"))
def f22(spark, sf):
    """Metadata within its bounds: 500 characters a text, 20 items a list, 4000 characters in all."""
    from ridgeline.functions.metadata import metadata, once

    told = lambda x: F.struct(F.length(x).alias("size"), F.sha2(x, 256).alias("digest"), (x == "{}").alias("bare"))
    return described(spark, sf).select("event_id", F.explode(F.array(once(metadata(F.col("metadata")), told))).alias("told")).select("event_id", "told.*")


@query("f14_json_paths", "with m as (select visitor_id, coalesce(k, 0) as k from ev), o as (select * from m where k % 13 <> 0 and k % 17 <> 0), e as (select visitor_id, k, unnest(range(0, k % 30 + 1)) as i from o) select visitor_id, cast(count(*) as bigint) as items, cast(max(i) as int) as last, cast(sum(length(i || repeat('w', k * 3))) as bigint) as chars, cast(max(k) as int) as b0, max(k + 0.5)::double as n from e group by 1")
def f14(spark, sf):
    """Values by path and a list exploded with its places, out of JSON read once as VARIANT."""
    v = described(spark, sf).withColumn("v", F.try_parse_json("metadata"))
    rows = v.lateralJoin(spark.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), "$.words", "variant")))
    word = F.try_variant_get("value", "$", "string")
    return rows.groupBy("visitor_id").agg(F.count("*").alias("items"), F.max("pos").alias("last"), F.sum(F.length(word)).alias("chars"), F.max(F.try_variant_get("v", "$.deep.a.b[0]", "int")).alias("b0"), F.max(F.try_variant_get("v", "$.deep.a.n", "double")).alias("n"))


# Health


@query("a34_expected_snapshots", "with w as (select cast(n_nationkey as int) as sigungu_key, level from nation cross join (select unnest(['1', '2', '3', '4', '5', '6']) as level)), h as (select sigungu_key, cast(type_id as varchar) as level, count(*) as n from deals join complexes using (complex_id) where month = '199903' group by 1, 2) select w.sigungu_key, w.level, cast(coalesce(n, 0) as bigint) as n, case when n is null then 'fail' when n < 3 then 'warn' else 'pass' end as status from w left join h using (sigungu_key, level)")
def a34(spark, sf):
    want = b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("sigungu_key"), F.explode(F.array(*map(F.lit, "123456"))).alias("level"))
    have = b.deals(spark, sf).where("month = '199903'").join(b.complexes(spark, sf).select("complex_id", "sigungu_key"), "complex_id").groupBy("sigungu_key", F.col("type_id").cast("string").alias("level")).agg(F.count("*").alias("n"))
    n = F.col("n")
    return want.join(have, ["sigungu_key", "level"], "left").select("sigungu_key", "level", F.coalesce(n, F.lit(0)).alias("n"), F.when(n.isNull(), "fail").when(n < 3, "warn").otherwise("pass").alias("status"))


@query("a35_coverage", "select cast(count(*) as bigint) as n, round(count(*) filter (lat > 37.01) / count(*), 6) as coordinates, round(count(*) filter (households > 0) / count(*), 6) as households, case when count(*) = 0 then 'fail' when count(*) filter (lat > 37.01) / count(*) < 0.8 or count(*) filter (households > 0) / count(*) < 0.5 then 'warn' else 'pass' end as status from complexes")
def a35(spark, sf):
    c = b.complexes(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("lat") > 37.01).alias("a"), F.count_if(F.col("households") > 0).alias("h"))
    a, h = F.try_divide("a", "n"), F.try_divide("h", "n")
    return c.select("n", numbers.rounded(a, 6).alias("coordinates"), numbers.rounded(h, 6).alias("households"), F.when(F.col("n") == 0, "fail").when((a < 0.8) | (h < 0.5), "warn").otherwise("pass").alias("status"))


@query("a36_run_summary", "select case when growth_rate < 0 then 'fail' when growth_rate < 0.05 then 'warn' else 'pass' end as status, cast(count(*) as bigint) as n, max(growth_amount) as most, cast(round(avg(growth_amount)) as int) as mean, arg_max(complex_id, (growth_amount, complex_id)) as slowest from items group by 1")
def a36(spark, sf):
    g = F.col("growth_rate")
    return bound_items(spark, sf).groupBy(F.when(g < 0, "fail").when(g < 0.05, "warn").otherwise("pass").alias("status")).agg(F.count("*").alias("n"), F.max("growth_amount").alias("most"), F.round(F.avg("growth_amount")).cast("int").alias("mean"), F.max_by("complex_id", F.struct("growth_amount", "complex_id")).alias("slowest"))


@query("a42_recent_months", "with m as (select strftime(unnest(generate_series(date '2001-07-01', date '2001-12-01', interval 1 month)), '%Y%m') as month), d as (select month, count(*) as n, count(distinct sigungu_key) as codes from deals join complexes using (complex_id) group by 1) select m.month, cast(coalesce(n, 0) as bigint) as n, cast(coalesce(codes, 0) as bigint) as codes, case when n is null then 'fail' when codes < 25 then 'warn' else 'pass' end as status from m left join d using (month)")
def a42(spark, sf):
    want = spark.range(1).select(F.explode(months.span(F.lit("200107"), F.lit("200112"))).alias("month"))
    have = b.deals(spark, sf).where("month >= '200107'").join(b.complexes(spark, sf).select("complex_id", "sigungu_key"), "complex_id").groupBy("month").agg(F.count("*").alias("n"), F.countDistinct("sigungu_key").alias("codes"))
    return want.join(have, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("codes", F.lit(0)).alias("codes"), F.when(F.col("n").isNull(), "fail").when(F.col("codes") < 25, "warn").otherwise("pass").alias("status"))


@query("a15_overview", "select cast((select count(*) from complexes) as bigint) as complexes, cast((select count(*) from deals) as bigint) as deals, cast((select count(distinct month) from deals) as bigint) as months, cast((select count(*) from (select distinct complex_id, type_id from deals)) as bigint) as types")
def a15(spark, sf):
    d = b.deals(spark, sf).agg(F.count("*").alias("deals"), F.countDistinct("month").alias("months"), F.countDistinct("complex_id", "type_id").alias("types"))
    return d.withColumn("complexes", b.complexes(spark, sf).agg(F.count("*")).scalar())


@query("a33_collection_status", "select coalesce(sido_name, '*') as sido, coalesce(sigungu_name, '*') as sigungu, cast(count(*) as bigint) as n, cast(count(*) filter (cancelled) as bigint) as cancelled from alldeals join complexes using (complex_id) group by rollup (sido_name, sigungu_name)")
def a33(spark, sf):
    rows = b.deals(spark, sf, cancelled=True).join(b.complexes(spark, sf).select("complex_id", "sido_name", "sigungu_name"), "complex_id")
    return rows.rollup("sido_name", "sigungu_name").agg(F.count("*").alias("n"), F.count_if("cancelled").alias("cancelled")).select(F.coalesce("sido_name", F.lit("*")).alias("sido"), F.coalesce("sigungu_name", F.lit("*")).alias("sigungu"), "n", "cancelled")

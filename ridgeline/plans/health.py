"""Health checks: a registry of named checks, each run by itself, side by side, into one report.

A check gives rows of details with a status each; its own status is the worst of them. A check that raises is a row
with status fail and the error as its message; the others go on.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import months, numbers
from ridgeline.operators import bands, entity, snapshots
from ridgeline.plans.growth import END, TODAY
from ridgeline.plans.registry import query
from ridgeline.plans.serving import ALL_BANDS, all_snapshots
from ridgeline.sources import bindings as b

REPORT = "key string, category string, title string, status string, message string, passed long, warned long, failed long, metrics string, took_ms long"

#: Limits of the checks.
COORDINATES, HOUSEHOLDS = 0.8, 0.5
STALE_HOURS = 36
READ_WARN_MS, READ_FAIL_MS = 1500, 5000
RUN_WARN_S, RUN_FAIL_S = 60, 300
MAP_LEVELS = ("sido", "sigungu", "dong", "apartment")


@dataclass(frozen=True)
class Context:
    """What the checks look at. Tables are frames: fetches (code, month, status, saved), deals (month, cancelled and more),
    complexes (lat, households), map_items (period, level, min_households, end_month, updated_at: one row an item),
    headers of price-band snapshots (see operators/snapshots.py); now is a timestamp's text."""

    spark: SparkSession
    fetches: DataFrame
    deals: DataFrame
    complexes: DataFrame
    map_items: DataFrame
    headers: DataFrame
    months: Sequence[str]
    codes: int
    end_month: str
    now: str
    periods: Sequence[int] = bands.PERIODS
    households: Sequence[int] = bands.HOUSEHOLDS
    reads: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)


Check = Callable[[Context], DataFrame]
CHECKS: dict[str, tuple[str, str, Check]] = {}


def check(category: str, title: str):
    def add(f: Check) -> Check:
        CHECKS[f.__name__] = (category, title, f)
        return f

    return add


def worst(fail: Column, warn: Column | None = None) -> Column:
    out = F.when(F.coalesce(fail, F.lit(True)), "fail")
    return (out.when(F.coalesce(warn, F.lit(False)), "warn") if warn is not None else out).otherwise("pass")


def _months(c: Context) -> DataFrame:
    return c.spark.createDataFrame([(m,) for m in c.months], "month string")


@check("collection", "Fetches of the recent months")
def recent_fetches(c: Context) -> DataFrame:
    """Every code must be completed in each recent month, none running or failed."""
    have = c.fetches.groupBy("month").agg(F.countDistinct(F.when(F.col("status") == "completed", F.col("code"))).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "started").alias("running"), F.sum(F.when(F.col("status") == "completed", F.col("saved"))).alias("saved"))
    rows = _months(c).join(have, "month", "left").na.fill(0)
    missing = F.greatest(F.lit(c.codes) - F.col("done"), F.lit(0))
    return rows.select(worst((missing > 0) | (F.col("failed") > 0) | (F.col("running") > 0)).alias("status"), F.struct("month", "done", missing.alias("missing"), "failed", "running", "saved").alias("metrics"))


@check("collection", "Deals of the recent months")
def recent_deals(c: Context) -> DataFrame:
    """Every recent month must hold deals; few valid ones are a warning."""
    have = c.deals.groupBy("month").agg(F.count("*").alias("deals"), F.count_if(~F.col("cancelled")).alias("valid"))
    rows = _months(c).join(have, "month", "left").na.fill(0)
    return rows.select(worst(F.col("deals") == 0, F.col("valid") * 2 < F.col("deals")).alias("status"), F.struct("month", "deals", "valid").alias("metrics"))


@check("coverage", "Places and households of complexes")
def complex_coverage(c: Context) -> DataFrame:
    n = c.complexes.agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("placed"), F.count_if(F.col("households") > 0).alias("counted"))
    a, h = F.try_divide("placed", "n"), F.try_divide("counted", "n")
    return n.select(worst(F.col("n") == 0, (a < COORDINATES) | (h < HOUSEHOLDS)).alias("status"), F.struct("n", numbers.rounded(a, 6).alias("coordinates"), numbers.rounded(h, 6).alias("households")).alias("metrics"))


def _stale(c: Context, at: str = "updated_at") -> Column:
    return snapshots.stale(F.col(at), F.lit(c.now).cast("timestamp"), STALE_HOURS)


@check("cache", "Map snapshots of every period, level and household limit")
def map_matrix(c: Context) -> DataFrame:
    """Missing snapshots and missing levels fail, stale ones warn."""
    want = c.spark.createDataFrame([(p, h) for p in c.periods for h in c.households], "period int, min_households int")
    have = c.map_items.where(F.col("end_month") == c.end_month).groupBy("period", "min_households").agg(F.collect_set("level").alias("levels"), F.count("*").alias("items"), F.max("updated_at").alias("updated_at"))
    lacking = F.array_except(F.array(*map(F.lit, MAP_LEVELS)), F.coalesce("levels", F.array().cast("array<string>")))
    reason = F.when(F.col("items").isNull(), "missing").when(F.size(lacking) > 0, F.concat(F.lit("missing_level:"), F.array_join(F.array_sort(lacking), "+"))).when(_stale(c), "stale_cache").otherwise("")
    return want.join(have, ["period", "min_households"], "left").select(worst(F.startswith(reason, F.lit("missing")), reason == "stale_cache").alias("status"), F.struct("period", "min_households", F.coalesce("items", F.lit(0)).alias("items"), reason.alias("reason")).alias("metrics"))


@check("cache", "Price-band snapshots of every period, basis, household limit and size band")
def band_matrix(c: Context) -> DataFrame:
    """A missing or empty snapshot of all sizes fails, an empty one of a size band or a stale one warns."""
    want = c.spark.createDataFrame([(months.shift(c.end_month, -p), s, h, a) for p in c.periods for s in bands.BASES for h in c.households for a in bands.AREA_BANDS], "start_month string, basis string, min_households int, area_band string")
    keys = ["start_month", "basis", "min_households", "area_band"]
    have = c.headers.where((F.col("end_month") == c.end_month) & (F.col("status") == "active")).groupBy(*keys).agg(F.max_by(F.struct("band_count", "item_count", "updated_at"), "updated_at").alias("h")).select(*keys, "h.*")
    empty = F.coalesce((F.col("band_count") == 0) | (F.col("item_count") == 0), F.lit(True))
    reason = F.when(empty & (F.col("area_band") == "all"), "core_empty_or_bands_missing").when(empty, "area_empty").when(_stale(c), "stale_cache").otherwise("")
    return want.join(have, keys, "left").select(worst(reason == "core_empty_or_bands_missing", reason != "").alias("status"), F.struct(*keys, F.coalesce("item_count", F.lit(0)).alias("items"), reason.alias("reason")).alias("metrics"))


@check("performance", "Reads of stored pages")
def read_times(c: Context) -> DataFrame:
    """Each named read is run; it fails without rows or beyond READ_FAIL_MS and warns beyond READ_WARN_MS."""
    found = []
    for name, read in c.reads.items():
        begun = time.perf_counter()
        rows = len(read().head(1))
        found.append((name, rows, int((time.perf_counter() - begun) * 1000)))
    rows = c.spark.createDataFrame(found, "read string, rows long, ms long")
    return rows.select(worst((F.col("rows") == 0) | (F.col("ms") > READ_FAIL_MS), F.col("ms") > READ_WARN_MS).alias("status"), F.struct("read", "rows", F.lit(READ_FAIL_MS).alias("limit_ms")).alias("metrics"))


@check("performance", "Jobs that run long")
def long_jobs(c: Context) -> DataFrame:
    """Spark's own active stages, by how long they have been running."""
    context, now, ages = c.spark.sparkContext, time.time(), []
    store = context._jsc.sc().statusStore()
    for stage in context.statusTracker().getActiveStageIds():
        begun = store.lastStageAttempt(stage).submissionTime()
        if begun.isDefined():
            ages.append((stage, int(now - begun.get().getTime() / 1000)))
    rows = c.spark.createDataFrame(ages or [(-1, 0)], "stage long, seconds long")
    return rows.select(worst(F.col("seconds") > RUN_FAIL_S, F.col("seconds") > RUN_WARN_S).alias("status"), F.struct("stage", F.lit(RUN_FAIL_S).alias("limit_s")).alias("metrics"))


def _one(name: str, context: Context, details: int) -> tuple:
    category, title, run = CHECKS[name]
    begun = time.perf_counter()
    took = lambda: int((time.perf_counter() - begun) * 1000)
    try:
        rows = run(context)
        n = {r["status"]: r["n"] for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()}  # three statuses
        order = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1).otherwise(2)
        first = [r[0] for r in rows.orderBy(order, F.to_json("metrics")).limit(details).select(F.to_json("metrics")).collect()]
        status = next((s for s in ("fail", "warn") if n.get(s)), "pass")
        message = f"{n.get('pass', 0)} of {sum(n.values())} pass"
        return name, category, title, status, message, n.get("pass", 0), n.get("warn", 0), n.get("fail", 0), json.dumps([json.loads(x) for x in first], ensure_ascii=False), took()
    except Exception as error:  # noqa: BLE001 - whatever a check raises is its result
        return name, "system", title, "fail", f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:500], 0, 0, 1, "[]", took()


def report(context: Context, names: Sequence[str] | None = None, details: int = 5, beside: int = 4) -> DataFrame:
    """One row a check, in the order of the registry; `beside` checks run at a time, each keeps its first `details` rows,
    the worst first."""
    names = list(CHECKS if names is None else names)
    with ThreadPoolExecutor(beside) as pool:
        found = list(pool.map(lambda n: _one(n, context, details), names))
    return context.spark.createDataFrame(found, REPORT)


def summary(runs: DataFrame) -> DataFrame:
    """One row: the worst status and how many checks pass, warn and fail."""
    n = lambda s: F.count_if(F.col("status") == s)
    return runs.agg(F.when(n("fail") > 0, "fail").when(n("warn") > 0, "warn").otherwise("pass").alias("status"), n("pass").alias("passed"), n("warn").alias("warned"), n("fail").alias("failed"), F.count("*").alias("checks"))


# Over the tests' tables


def context_of(spark, sf) -> Context:
    """Deals by district and month are fetches: those of one district and month failed."""
    root = f"{entity.shared_root(spark)}/health-{uuid.uuid4().hex}"
    all_snapshots(spark, sf, root)
    deals = b.deals(spark, sf, cancelled=True)
    named = b.complexes(spark, sf)
    fetched = deals.join(named.select("complex_id", F.col("sigungu_key").cast("string").alias("code")), "complex_id").groupBy("code", "month").agg(F.count("*").alias("saved"))
    fetches = fetched.withColumn("status", F.when((F.col("code") == "3") & (F.col("month") == "200005"), "failed").otherwise("completed"))
    return Context(spark, fetches, deals, named, _map_items(spark, sf, END), snapshots.headers(spark, root), [months.shift(END, -i) for i in range(3)], 25, END, f"{TODAY} 12:00:00")


def _map_items(spark, sf, end: str) -> DataFrame:
    """Orders as items of map snapshots: the level by status and date, so that a level of one period is missing."""
    o = b.table(spark, sf, "orders")
    period = F.get(F.array(*map(F.lit, bands.PERIODS)), (F.col("o_orderkey") % 5).cast("int"))
    level = F.get(F.array(*map(F.lit, MAP_LEVELS)), (F.col("o_custkey") % 4).cast("int"))
    at = F.when(F.col("o_orderkey") % 5 == 4, F.lit("2000-06-01")).otherwise(F.lit("2000-06-15")).cast("timestamp")
    rows = o.select(period.alias("period"), level.alias("level"), F.when(F.col("o_custkey") % 8 < 4, 0).otherwise(100).alias("min_households"), F.lit(end).alias("end_month"), at.alias("updated_at"))
    return rows.where("not (period = 12 and level = 'dong')")


def broken(context: Context) -> DataFrame:
    return context.spark.range(1).select(F.raise_error(F.lit("broken on purpose")).alias("status"), F.struct("id").alias("metrics"))


MATRIX = "with recent as (select * from (values ('200006'), ('200005'), ('200004')) t(month)), f as (select n_nationkey as code, strftime(l_shipdate, '%Y%m') as month, count(*) as saved from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2), ff as (select month, count(distinct code) filter (not (code = 3 and month = '200005')) as done, count(*) filter (code = 3 and month = '200005') as failed from f group by 1), fetched as (select case when coalesce(done, 0) < 25 or coalesce(failed, 0) > 0 then 'fail' else 'pass' end as status from recent left join ff using (month)), d as (select month, count(*) as n, count(*) filter (not cancelled) as valid from alldeals group by 1), deal as (select case when coalesce(n, 0) = 0 then 'fail' when valid * 2 < n then 'warn' else 'pass' end as status from recent left join d using (month)), cover as (select case when count(*) = 0 then 'fail' when count(lat) / count(*) < 0.8 or count(*) filter (households > 0) / count(*) < 0.5 then 'warn' else 'pass' end as status from complexes), mi as (select [3, 6, 12, 36, 60][o_orderkey % 5 + 1] as period, case when o_custkey % 8 < 4 then 0 else 100 end as hh, ['sido', 'sigungu', 'dong', 'apartment'][o_custkey % 4 + 1] as level, o_orderkey % 5 = 4 as old from orders), mg as (select period, hh, count(distinct level) as levels, bool_and(old) as old from mi where not (period = 12 and level = 'dong') group by 1, 2), maps as (select case when levels is null or levels < 4 then 'fail' when old then 'warn' else 'pass' end as status from (select unnest([3, 6, 12, 36, 60]) as period) cross join (select unnest([0, 100]) as hh) left join mg using (period, hh))"


@query("x4_health_report", MATRIX + ", every as (select 'recent_fetches' as key, status from fetched union all select 'recent_deals', status from deal union all select 'complex_coverage', status from cover union all select 'map_matrix', status from maps) select key, case when count(*) filter (status = 'fail') > 0 then 'fail' when count(*) filter (status = 'warn') > 0 then 'warn' else 'pass' end as status, cast(count(*) filter (status = 'pass') as bigint) as passed, cast(count(*) filter (status = 'warn') as bigint) as warned, cast(count(*) filter (status = 'fail') as bigint) as failed from every group by 1 union all select 'broken', 'fail', 0, 0, 1")
def x4(spark, sf):
    """Four of the checks and one that raises, each by itself, in one table."""
    CHECKS["broken"] = ("system", "Raises", broken)
    try:
        found = report(context_of(spark, sf), ["recent_fetches", "recent_deals", "complex_coverage", "map_matrix", "broken"])
    finally:
        del CHECKS["broken"]
    return found.select("key", "status", "passed", "warned", "failed")


@query("a34_band_matrix", ALL_BANDS + " select w.start_month, w.basis, cast(w.min_households as int) as min_households, w.area_band, cast(count(complex_id) as bigint) as items, case when count(complex_id) = 0 and w.area_band = 'all' then 'fail' else 'warn' end as status, case when count(complex_id) = 0 and w.area_band = 'all' then 'core_empty_or_bands_missing' when count(complex_id) = 0 then 'area_empty' else 'stale_cache' end as reason from (select start_month, basis, min_households, unnest(['all', 'under10', '10', '20', '30', '40', '50', '60plus']) as area_band from per, kinds) w left join ranked r using (start_month, area_band, basis, min_households) group by 1, 2, 3, 4")
def a34_bands(spark, sf):
    """The matrix of price-band snapshots as it would look two days after they were built."""
    c = context_of(spark, sf)
    later = c.headers.agg(F.max("updated_at") + F.expr("interval 2 days")).first()[0].isoformat(" ")
    rows = band_matrix(Context(**{**c.__dict__, "now": later}))
    return rows.select("metrics.start_month", "metrics.basis", "metrics.min_households", "metrics.area_band", "metrics.items", "status", "metrics.reason")

"""Growth between two months: types, complexes, bands, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import months, numbers
from ridgeline.operators import prices, ranks
from ridgeline.plans.registry import query
from ridgeline.sources import bindings as b

START, END, TODAY = "199606", "200006", "2000-06-15"


def best(*more: str):
    return [F.col("growth_rate").desc_nulls_last(), *(F.col(m).desc_nulls_last() for m in more), F.col("complex_id").asc_nulls_last()]


def ends(monthly: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Per type its start and end prices, each carried from at or before the month."""
    found = prices.asof(monthly, prices.TYPE, {"s": start, "e": end}, ["price", "pyeong"])
    return found.select(*prices.TYPE, *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("s", "start"), ("e", "end")) for c in ("month", "price", "pyeong")))


def items(monthly: DataFrame, complexes: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """Complexes with growth as the ratio of mean prices per pyeong over their types."""
    means = ends(monthly, start, end).where("start_pyeong is not null").groupBy("complex_id").agg(F.avg("start_pyeong").alias("s"), F.avg("end_pyeong").alias("e"), F.count("*").cast("int").alias("types"))
    found = means.join(complexes, "complex_id")
    return found.select(*complexes.columns, "types", numbers.js_round(F.col("s")).cast("int").alias("start_pyeong"), numbers.js_round(F.col("e")).cast("int").alias("end_pyeong"), numbers.rounded(numbers.growth(F.col("s"), F.col("e")), 6).alias("growth_rate"), numbers.js_round(F.col("e") - F.col("s")).cast("int").alias("growth_amount"))


def bound_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(prices.monthly(b.deals(spark, sf)), b.complexes(spark, sf))


def bound_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return prices.monthly(b.deals(spark, sf))


@query("top_growth", "select complex_id, name, sido_name, sigungu_name, types, start_pyeong, end_pyeong, growth_amount, growth_rate, cast(row_number() over (order by growth_rate desc nulls last, growth_amount desc nulls last, complex_id) as int) as rank from items qualify rank <= 50")
def top_growth(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: valid deals, monthly prices, start and end as of two months, growth, the first 50."""
    found = ranks.page(bound_items(spark, sf), best("growth_amount"), 1, 50)
    return found.select("complex_id", "name", "sido_name", "sigungu_name", "types", "start_pyeong", "end_pyeong", "growth_amount", "growth_rate", "rank")


@query("p1_valid_deals", "select month, cast(count(*) as bigint) as n, cast(sum(amount) as bigint) as amount from deals group by month")
def p1(spark, sf):
    return b.deals(spark, sf).groupBy("month").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("p2_month_range", "select complex_id, cast(count(*) as bigint) as n from deals where month between '199701' and '199806' group by 1")
def p2(spark, sf):
    return b.deals(spark, sf).where(F.col("month").between("199701", "199806")).groupBy("complex_id").agg(F.count("*").alias("n"))


@query("p5_household_filter", "select complex_id, name, households from complexes where coalesce(households, 0) >= 1000")
def p5(spark, sf, least: int = 1000):
    rows = b.complexes(spark, sf)
    return (rows if least <= 0 else rows.where(F.coalesce("households", F.lit(0)) >= least)).select("complex_id", "name", "households")


@query("p7_bounds", "select complex_id, lat, lng from complexes where lat between 37.02 and 37.06 and lng between 127.01 and 127.08")
def p7(spark, sf):
    from ridgeline.functions.geo import within

    return b.complexes(spark, sf).where(within(F.col("lat"), F.col("lng"), 37.02, 127.01, 37.06, 127.08)).select("complex_id", "lat", "lng")


@query("p10_area_band", "select case when m2 <= 10 then 'under10' when m2 >= 60 then '60plus' else cast(cast(floor(m2 / 10) * 10 as int) as varchar) end as band, cast(count(*) as bigint) as n from deals group by 1")
def p10(spark, sf):
    return b.deals(spark, sf).groupBy(numbers.area_band(F.col("m2")).alias("band")).agg(F.count("*").alias("n"))


BAND = "cast(case when {x} / 10000 < 1 then 0 when {x} / 10000 < 10 then floor({x} / 10000) else floor({x} / 100000) * 10 end as int)"


@query("p11_price_band", f"select {BAND.format(x='amount')} as band_key, cast(count(*) as bigint) as n, min(amount) as least, max(amount) as most from deals group by 1")
def p11(spark, sf):
    return b.deals(spark, sf).groupBy(numbers.band_key(F.col("amount")).alias("band_key")).agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("most"))


@query("p12_band_range", "select order_id, line_no, amount from deals where amount >= 30000 and amount < 40000")
def p12(spark, sf):
    low, high = numbers.band_range(3)
    return b.deals(spark, sf).where((F.col("amount") >= low) & (F.col("amount") < high)).select("order_id", "line_no", "amount")


IDX = "(cast({m}[1:4] as int) * 12 + cast({m}[5:6] as int) - 1)"


@query("p14_fresh_prices", f"select complex_id, type_id, start_month, end_month from ends where (1996 * 12 + 5) - {IDX.format(m='start_month')} between 0 and 6 and (2000 * 12 + 5) - {IDX.format(m='end_month')} between 0 and 3")
def p14(spark, sf):
    a, z = months.freshness(36)
    e = ends(bound_monthly(spark, sf))
    return e.where(months.fresh(F.col("start_month"), F.lit(START), a) & months.fresh(F.col("end_month"), F.lit(END), z)).select("complex_id", "type_id", "start_month", "end_month")


@query("p27_growth_tone", "with t as (select complex_id, case when round(growth_rate * 100, 1) = 0 then 0.0 else round(growth_rate * 100, 1) end as shown from items) select complex_id, shown, case when shown is null or shown = 0 then 'neutral' when shown < 0 then 'negative' when shown >= 20 then 'top1' when shown >= 10 then 'top2' else 'top3' end as tone from t")
def p27(spark, sf):
    return bound_items(spark, sf).select("complex_id", numbers.percent(F.col("growth_rate")).alias("shown"), numbers.tone(F.col("growth_rate")).alias("tone"))


@query("p33_period_bucket", f"select complex_id, type_id, cast(case when d >= 54 then 60 when d >= 30 then 36 when d >= 9 then 12 when d >= 5 then 6 else 3 end as int) as period from (select *, {IDX.format(m='end_month')} - {IDX.format(m='start_month')} as d from ends where start_month is not null)")
def p33(spark, sf):
    e = ends(bound_monthly(spark, sf)).where("start_month is not null")
    return e.select("complex_id", "type_id", numbers.period_bucket(months.between(F.col("start_month"), F.col("end_month"))).alias("period"))


@query("j1_deals_with_complexes", "select sigungu_name, month, cast(count(*) as bigint) as n, cast(sum(amount) as bigint) as amount from deals join complexes using (complex_id) group by 1, 2")
def j1(spark, sf):
    return b.deals(spark, sf).join(b.complexes(spark, sf), "complex_id").groupBy("sigungu_name", "month").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("j2_household_coalesce", "select c.complex_id, cast(coalesce(nullif(p.parts, 0), c.households, 0) as bigint) as households from complexes c left join (select complex_id, count(distinct order_id) as parts from deals where month <= '199503' group by 1) p using (complex_id)")
def j2(spark, sf):
    few = b.deals(spark, sf).where("month <= '199503'").groupBy("complex_id").agg(F.countDistinct("order_id").alias("parts"))
    return b.complexes(spark, sf).join(few, "complex_id", "left").select("complex_id", F.coalesce(F.nullif("parts", F.lit(0)), "households", F.lit(0)).cast("long").alias("households"))


@query("j4_period_overlap", "select greatest(a.lo, q.lo) as start_month, least(a.hi, q.hi) as end_month from (select min(month) lo, max(month) hi from deals) a, (select min(month) lo, max(month) hi from quotes) q")
def j4(spark, sf):
    span = lambda d: d.agg(F.min("month").alias("lo"), F.max("month").alias("hi"), F.lit(1).alias("one"))
    a, q = span(b.deals(spark, sf)).alias("a"), span(b.quotes(spark, sf)).alias("q")
    return a.join(q, "one").select(F.greatest("a.lo", "q.lo").alias("start_month"), F.least("a.hi", "q.hi").alias("end_month"))


@query("j15_asof_backward", "select complex_id, type_id, start_month, start_price, end_month, end_price from ends")
def j15(spark, sf):
    return ends(bound_monthly(spark, sf)).select("complex_id", "type_id", "start_month", "start_price", "end_month", "end_price")


@query("j16_asof_forward", "select complex_id, type_id, min(month) as month, arg_min(price, month) as price from monthly where month >= '199801' group by 1, 2")
def j16(spark, sf):
    f = prices.asof(bound_monthly(spark, sf), prices.TYPE, {"f": "199801"}, ["price"], forward=True)
    return f.select("complex_id", "type_id", "f.month", "f.price")


@query("j21_recent_or_carried", "select e.complex_id, e.type_id, coalesce(r.price, e.end_price) as price, coalesce(r.source_month, e.end_month) as source_month, r.price is not null as is_recent from ends e left join (select complex_id, type_id, cast(round(avg(amount)) as int) as price, max(month) as source_month from deals where deal_date between date '2000-05-16' and date '2000-06-15' group by 1, 2) r using (complex_id, type_id)")
def j21(spark, sf):
    deals = b.deals(spark, sf)
    r = prices.recent(deals, TODAY).select(*prices.TYPE, "price", "source_month")
    e = ends(prices.monthly(deals)).join(r, list(prices.TYPE), "left")
    return e.select(*prices.TYPE, F.coalesce("price", "end_price").alias("price"), F.coalesce("source_month", "end_month").alias("source_month"), F.col("price").isNotNull().alias("is_recent"))


@query("j22_no_data_items", "select complex_id, growth_rate, true as has_data from items where growth_rate > 0 union all select complex_id, null, false from complexes where complex_id not in (select complex_id from items where growth_rate > 0)")
def j22(spark, sf):
    have = bound_items(spark, sf).where("growth_rate > 0").select("complex_id", "growth_rate", F.lit(True).alias("has_data"))
    none = b.complexes(spark, sf).join(have.select("complex_id"), "complex_id", "left_anti").select("complex_id", F.lit(False).alias("has_data"))
    return have.unionByName(none, allowMissingColumns=True)


CAL = "cal as (select strftime(unnest(generate_series(date '1997-01-01', date '1997-12-01', interval 1 month)), '%Y%m') as month)"


@query("j26_calendar_carry", f"with {CAL}, t as (select distinct complex_id, type_id from monthly), x as (select complex_id, type_id, cal.month, m.price as own from t cross join cal left join monthly m using (complex_id, type_id, month)), p as (select complex_id, type_id, arg_max(price, month) as before from monthly where month < '199701' group by 1, 2) select complex_id, type_id, month, own, coalesce(last_value(own ignore nulls) over (partition by complex_id, type_id order by month), before) as price from x left join p using (complex_id, type_id)")
def j26(spark, sf):
    return prices.densify(bound_monthly(spark, sf), prices.TYPE, "199701", "199712", "price")


OFFSETS = (3, 6, 12, 36, 60)


@query("j33_trades_vs_base", f"with o as (select unnest([3, 6, 12, 36, 60]) as back), d as (select complex_id, type_id, order_id, line_no, month, amount, back, strftime(strptime(month || '01', '%Y%m%d') - to_months(cast(back as int)), '%Y%m') as base_month from deals, o) select d.complex_id, d.type_id, order_id, line_no, amount, cast(back as int) as back, base_month, m.month as found_month, m.price as base_price, round(amount / m.price - 1, 6) as change from d asof left join monthly m on d.complex_id = m.complex_id and d.type_id = m.type_id and d.base_month >= m.month")
def j33(spark, sf):
    deals = b.deals(spark, sf)
    rows = deals.select(*prices.TYPE, "order_id", "line_no", "month", "amount", F.explode(F.array(*map(F.lit, OFFSETS))).alias("back"))
    rows = rows.withColumn("base_month", months.add(F.col("month"), -F.col("back"))).drop("month")
    found = prices.asof_many(rows, prices.monthly(deals), prices.TYPE, "base_month", ["price"])
    return found.select(*prices.TYPE, "order_id", "line_no", "amount", "back", "base_month", F.col("found.month").alias("found_month"), F.col("found.price").alias("base_price"), numbers.rounded(numbers.growth(F.col("found.price"), F.col("amount")), 6).alias("change"))


@query("j34_nearest_area", "select complex_id, arg_min(m2, (abs(m2 - 24.8), order_id, line_no)) as m2 from deals where abs(m2 - 24.8) <= 0.35 group by 1")
def j34(spark, sf):
    off = F.abs(F.col("m2") - 24.8)
    return b.deals(spark, sf).where(off <= 0.35).groupBy("complex_id").agg(F.min_by("m2", F.struct(off, "order_id", "line_no")).alias("m2"))


@query("j35_change_by_years", "select complex_id, type_id, arg_max(price, month) as latest, arg_max(price, month) filter (month <= '199906') as year1, arg_max(price, month) filter (month <= '199706') as year3, arg_max(price, month) filter (month <= '199506') as year5 from monthly where month <= '200006' group by 1, 2")
def j35(spark, sf):
    t = {"latest": END, **{f"year{n}": months.shift(END, -12 * n) for n in (1, 3, 5)}}
    f = prices.asof(bound_monthly(spark, sf), prices.TYPE, t, ["price"])
    return f.select(*prices.TYPE, *(F.col(f"{n}.price").alias(n) for n in t))


@query("a1_monthly_price", "select complex_id, type_id, month, price, low, high, pyeong, cast(deals as bigint) as deals from monthly")
def a1(spark, sf):
    return bound_monthly(spark, sf)


@query("a2_recent_price", "select complex_id, type_id, cast(round(avg(amount)) as int) as price, cast(round(avg(pyeong)) as int) as pyeong, cast(count(*) as bigint) as deals, max(month) as source_month from deals where deal_date between date '2000-05-16' and date '2000-06-15' group by 1, 2")
def a2(spark, sf):
    return prices.recent(b.deals(spark, sf), TODAY)


@query("a3_one_complex", "select type_id, month, price, low, high, cast(deals as bigint) as deals from monthly where complex_id = 7")
def a3(spark, sf):
    return prices.monthly(b.deals(spark, sf).where("complex_id = 7")).select("type_id", "month", "price", "low", "high", "deals")


@query("a4_complex_master", "select complex_id, string_agg(distinct cast(type_id as varchar), ',' order by cast(type_id as varchar)) as types, min(month) as first_month, max(month) as last_month, cast(count(*) as bigint) as deals, min(amount) filter (type_id = 1) as least_small from deals group by 1")
def a4(spark, sf):
    return b.deals(spark, sf).groupBy("complex_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("type_id").cast("string"))), ",").alias("types"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("deals"), F.min(F.when(F.col("type_id") == 1, F.col("amount"))).alias("least_small"))


@query("a6_conditional_counts", "select complex_id, cast(count(*) as bigint) as n, cast(count(*) filter (cancelled) as bigint) as cancelled, cast(count(*) filter (amount >= 50000) as bigint) as large, cast(count(distinct month) filter (not cancelled) as bigint) as months from alldeals group by 1")
def a6(spark, sf):
    return b.deals(spark, sf, cancelled=True).groupBy("complex_id").agg(F.count("*").alias("n"), F.count_if("cancelled").alias("cancelled"), F.count_if(F.col("amount") >= 50000).alias("large"), F.countDistinct(F.when(~F.col("cancelled"), F.col("month"))).alias("months"))


@query("a16_average_of_averages", "select complex_id, types, start_pyeong, end_pyeong, growth_amount, growth_rate from items")
def a16(spark, sf):
    return bound_items(spark, sf).select("complex_id", "types", "start_pyeong", "end_pyeong", "growth_amount", "growth_rate")


def mean_over_period(monthly: DataFrame, first: str, last: str) -> DataFrame:
    """Complexes with the mean over their types of each type's mean price per pyeong, and their months.

    A mean of means is a sum of fractions, so its last bits follow the order of the rows: it is rounded to nine digits before
    it is rounded half up. So halves go up whatever the order, and nothing else comes that near to one.
    """
    m = monthly.where(F.col("month").between(first, last))
    types = m.groupBy("complex_id", "type_id").agg(F.avg("pyeong").alias("p"), F.collect_set("month").alias("ms"))
    mean = numbers.js_round(numbers.rounded(F.avg("p"), 9)).cast("int")
    return types.groupBy("complex_id").agg(mean.alias("pyeong"), F.size(F.array_distinct(F.flatten(F.collect_list("ms")))).cast("long").alias("observed_months"))


@query("a17_mean_over_period", "with t as (select complex_id, type_id, avg(pyeong) as p from monthly where month between '199701' and '199912' group by 1, 2) select t.complex_id, cast(floor(avg(p) + 0.5) as int) as pyeong, any_value(o.n) as observed_months from t join (select complex_id, cast(count(distinct month) as bigint) as n from monthly where month between '199701' and '199912' group by 1) o using (complex_id) group by 1")
def a17(spark, sf):
    return mean_over_period(bound_monthly(spark, sf), "199701", "199912")


@query("a18_neighborhood_rank", "with n as (select dong_key, cast(count(*) as bigint) as areas, avg(start_pyeong) as s, avg(end_pyeong) as e from ends join complexes using (complex_id) where start_pyeong is not null group by 1) select dong_key, areas, round(e / s - 1, 6) as growth_rate, cast(row_number() over (order by round(e / s - 1, 6) desc nulls last, dong_key) as int) as rank from n")
def a18(spark, sf):
    e = ends(bound_monthly(spark, sf)).where("start_pyeong is not null").join(b.complexes(spark, sf).select("complex_id", "dong_key"), "complex_id")
    n = e.groupBy("dong_key").agg(F.count("*").alias("areas"), numbers.rounded(numbers.growth(F.avg("start_pyeong"), F.avg("end_pyeong")), 6).alias("growth_rate"))
    return ranks.table_rank(n, [F.col("growth_rate").desc_nulls_last(), F.col("dong_key").asc()], "rank")


@query("a19_index_chart", "with m as (select dong_key, month, avg(pyeong) as p from monthly join complexes using (complex_id) where month between '199801' and '199812' group by 1, 2) select dong_key, month, round(100 * p / first_value(p) over (partition by dong_key order by month), 1) as index from m")
def a19(spark, sf):
    m = bound_monthly(spark, sf).where(F.col("month").between("199801", "199812")).join(b.complexes(spark, sf).select("complex_id", "dong_key"), "complex_id").groupBy("dong_key", "month").agg(F.avg("pyeong").alias("p"))
    return m.select("dong_key", "month", numbers.rounded(100 * F.col("p") / F.first(F.when(F.col("p") > 0, F.col("p")), True).over(Window.partitionBy("dong_key").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 1).alias("index"))


REP = "rep as (select complex_id, type_id, start_price, end_price, start_pyeong, end_pyeong, round(end_price / start_price - 1, 6) as growth_rate, end_price - start_price as growth_amount from ends where start_price is not null qualify row_number() over (partition by complex_id order by round(end_price / start_price - 1, 6) desc nulls last, end_price - start_price desc, end_price desc, type_id) = 1), " + f"banded as (select *, {BAND.format(x='end_price')} as band_key from rep)"


def representatives(spark, sf):
    """Per complex the type whose sale price grew most, in the band of its end price."""
    e = ends(bound_monthly(spark, sf)).where("start_price is not null").withColumns({"growth_rate": numbers.rounded(numbers.growth(F.col("start_price"), F.col("end_price")), 6), "growth_amount": F.col("end_price") - F.col("start_price")})
    rep = ranks.first_by(e, ["complex_id"], [F.col("growth_rate").desc_nulls_last(), F.col("growth_amount").desc(), F.col("end_price").desc(), F.col("type_id")])
    return rep.withColumn("band_key", numbers.band_key(F.col("end_price")))


@query("a21_price_bands", f"with {REP} select band_key, cast(count(*) as bigint) as complexes, cast(round(avg(start_price)) as int) as start_price, cast(round(avg(end_price)) as int) as end_price, round(avg(end_pyeong) / avg(start_pyeong) - 1, 6) as growth_rate, max(growth_rate) as top_growth, arg_max(complex_id, (growth_rate, -complex_id)) as top_complex from banded group by 1")
def a21(spark, sf):
    return representatives(spark, sf).groupBy("band_key").agg(F.count("*").alias("complexes"), prices.mean_int("start_price").alias("start_price"), prices.mean_int("end_price").alias("end_price"), numbers.rounded(numbers.growth(F.avg("start_pyeong"), F.avg("end_pyeong")), 6).alias("growth_rate"), F.max("growth_rate").alias("top_growth"), F.max_by("complex_id", F.struct("growth_rate", -F.col("complex_id"))).alias("top_complex"))


@query("a24_region_rollup", "select case grouping_id(sido_key, sigungu_key, dong_key) when 3 then 'sido' when 1 then 'sigungu' else 'dong' end as level, sido_key, sigungu_key, dong_key, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng, round(avg(growth_rate), 6) as growth_rate, cast(floor(avg(growth_amount) + 0.5) as int) as growth_amount, cast(count(distinct complex_id) as bigint) as complexes, cast(sum(types) as bigint) as types from items group by grouping sets ((sido_key), (sido_key, sigungu_key), (sido_key, sigungu_key, dong_key))")
def a24(spark, sf):
    return ranks.rollup(bound_items(spark, sf))


@query("a25_region_options", "select sigungu_key, max(nullif(sigungu_name, '')) as name, cast(count(*) as bigint) as n from complexes group by 1")
def a25(spark, sf):
    return b.complexes(spark, sf).groupBy("sigungu_key").agg(F.max(F.nullif("sigungu_name", F.lit(""))).alias("name"), F.count("*").alias("n"))


@query("a31_sitemap", "select complex_id, max(growth_rate) as growth_rate, min(name) as name from items group by 1 order by growth_rate desc nulls last, complex_id limit 1000")
def a31(spark, sf):
    return bound_items(spark, sf).groupBy("complex_id").agg(F.max("growth_rate").alias("growth_rate"), F.min("name").alias("name")).orderBy(F.col("growth_rate").desc_nulls_last(), "complex_id").limit(1000)


@query("a37_area_label", "select complex_id, case count(distinct type_id) when 0 then '-' when 1 then cast(min(type_id) as varchar) else count(distinct type_id) || '개 면적' end as label from deals group by 1")
def a37(spark, sf):
    n = F.countDistinct("type_id")
    return b.deals(spark, sf).groupBy("complex_id").agg(n.alias("n"), F.min("type_id").alias("one")).select("complex_id", F.when(F.col("n") == 0, "-").when(F.col("n") == 1, F.col("one").cast("string")).otherwise(F.concat(F.col("n").cast("string"), F.lit("개 면적"))).alias("label"))


@query("a38_monthly_mean", "select complex_id, month, cast(floor(avg(pyeong) + 0.5) as int) as pyeong from monthly group by 1, 2")
def a38(spark, sf):
    return bound_monthly(spark, sf).groupBy("complex_id", "month").agg(numbers.js_round(F.avg("pyeong")).cast("int").alias("pyeong"))


SCOPES = {"dong": ["dong_key"], "sigungu": ["sigungu_key"], "sido": ["sido_key"], "country": []}


@query("w1_scope_ranks", "select complex_id, " + ", ".join(f"cast(row_number() over (partition by {k} order by growth_rate desc nulls last, complex_id) as int) as {n}_rank, cast(count(*) over (partition by {k}) as int) as {n}_total" for n, k in (("dong", "dong_key"), ("sigungu", "sigungu_key"), ("sido", "sido_key"), ("country", "1"))) + " from items")
def w1(spark, sf):
    found = ranks.scope_ranks(bound_items(spark, sf), SCOPES, best())
    return found.select("complex_id", *(f"{n}_{x}" for n in SCOPES for x in ("rank", "total")))


@query("w4_latest_trades", "select complex_id, type_id, order_id, line_no, deal_date, amount from (select *, row_number() over (partition by complex_id, type_id order by deal_date desc, order_id desc, line_no desc, amount desc, m2 desc) as rn from deals) where rn <= 10")
def w4(spark, sf):
    d = F.col
    found = ranks.first_by(b.deals(spark, sf), prices.TYPE, [d(c).desc() for c in ("deal_date", "order_id", "line_no", "amount", "m2")], 10)
    return found.select("complex_id", "type_id", "order_id", "line_no", "deal_date", "amount")


@query("w5_page_rank", "select complex_id, growth_rate, cast(row_number() over (order by growth_rate desc nulls last, complex_id) as int) as rank from items qualify rank between 21 and 40")
def w5(spark, sf):
    return ranks.page(bound_items(spark, sf), best(), 2, 20).select("complex_id", "growth_rate", "rank")


@query("w9_rank_in_band", f"with {REP} select band_key, complex_id, type_id, growth_rate, cast(row_number() over (partition by band_key order by growth_rate desc nulls last, growth_amount desc, end_pyeong desc, complex_id) as int) as rank from banded")
def w9(spark, sf):
    w = Window.partitionBy("band_key").orderBy(F.col("growth_rate").desc_nulls_last(), F.col("growth_amount").desc(), F.col("end_pyeong").desc(), "complex_id")
    return representatives(spark, sf).select("band_key", "complex_id", "type_id", "growth_rate", F.row_number().over(w).cast("int").alias("rank"))


@query("w15_interpolation", f"with p as (select complex_id, type_id, max(month) filter (month <= '199803') as ma, arg_max(price, month) filter (month <= '199803') as va, min(month) filter (month >= '199803') as mb, arg_min(price, month) filter (month >= '199803') as vb from monthly group by 1, 2) select complex_id, type_id, case when ma = mb then va::double else va + (vb - va) * (1998 * 12 + 2 - {IDX.format(m='ma')}) / ({IDX.format(m='mb')} - {IDX.format(m='ma')}) end as price from p")
def w15(spark, sf):
    return prices.interpolate(bound_monthly(spark, sf), prices.TYPE, "199803", "price")


@query("w16_rank_percent", "select complex_id, round(row_number() over (order by growth_rate desc nulls last, complex_id) / count(*) over () * 100, 6) as percent from items")
def w16(spark, sf):
    r = ranks.scope_ranks(bound_items(spark, sf), {"all": []}, best())
    return r.select("complex_id", numbers.rounded(F.col("all_rank") / F.col("all_total") * 100, 6).alias("percent"))


@query("w18_default_type", "select complex_id, arg_max(type_id, (n, type_id)) as type_id from (select complex_id, type_id, count(*) as n from deals group by 1, 2) group by 1")
def w18(spark, sf):
    n = b.deals(spark, sf).groupBy("complex_id", "type_id").agg(F.count("*").alias("n"))
    return n.groupBy("complex_id").agg(F.max_by("type_id", F.struct("n", "type_id")).alias("type_id"))


@query("o2_map_order", "select complex_id, growth_rate, types from items order by growth_rate desc nulls last, types desc, name, complex_id limit 20")
def o2(spark, sf):
    return bound_items(spark, sf).orderBy(F.col("growth_rate").desc_nulls_last(), F.col("types").desc(), "name", "complex_id").limit(20).select("complex_id", "growth_rate", "types")


@query("u1_start_and_end_rows", "select complex_id, type_id, start_month as month, start_price as price from ends where start_month is not null union select complex_id, type_id, end_month, end_price from ends where end_month is not null")
def u1(spark, sf):
    e = ends(bound_monthly(spark, sf))
    side = lambda s: e.where(f"{s}_month is not null").select(*prices.TYPE, F.col(f"{s}_month").alias("month"), F.col(f"{s}_price").alias("price"))
    return side("start").unionByName(side("end")).distinct()


@query("f10_rounding", "select order_id, line_no, cast(floor((amount - 40000) / 2 + 0.5) as bigint) as js, cast(round((amount - 40000) / 2) as bigint) as away from deals")
def f10(spark, sf):
    x = (F.col("amount") - 40000) / 2
    return b.deals(spark, sf).select("order_id", "line_no", numbers.js_round(x).alias("js"), F.round(x).cast("long").alias("away"))


@query("f11_month_arithmetic", f"with m as (select distinct month from deals) select month, strftime(strptime(month || '01', '%Y%m%d') + interval 7 month, '%Y%m') as later, strftime(strptime(month || '01', '%Y%m%d') - interval 14 month, '%Y%m') as earlier, 1998 * 12 - {IDX.format(m='month')} as to_1998 from m")
def f11(spark, sf):
    m = F.col("month")
    return b.deals(spark, sf).select("month").distinct().select(m, months.add(m, 7).alias("later"), months.add(m, -14).alias("earlier"), months.between(m, F.lit("199801")).alias("to_1998"))

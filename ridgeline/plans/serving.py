"""What is stored and served: snapshots of bands and their items, headers, trades as they come, jobs and their queue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import months, numbers
from ridgeline.operators import bands, entity, prices, ranks, snapshots
from ridgeline.plans.growth import END, REP, START, TODAY, bound_items, bound_monthly, ends, representatives
from ridgeline.plans.registry import more, query
from ridgeline.sources import bindings as b
from ridgeline.sources import trades

# Stored bands and their items

ITEMS = f"with {REP}, stored as (select banded.*, c.name, c.sido_key, c.sigungu_key, c.dong_key from banded join complexes c using (complex_id))"


def stored_items(spark, sf) -> DataFrame:
    return representatives(spark, sf).join(b.complexes(spark, sf).select("complex_id", "name", "sido_key", "sigungu_key", "dong_key"), "complex_id")


def band_filter(basis: str, start_band: int | None = None, end_band: int | None = None, **region):
    """The predicate for a page of stored items: the band of the snapshot's own basis by key, that of the other basis by
    its price range, regions by equality where given."""
    found = F.lit(True)
    for side, key in (("start", start_band), ("end", end_band)):
        if key is None:
            continue
        if side == basis:
            found &= F.col("band_key") == key
            continue
        low, high = numbers.band_range(key)
        price = F.col(f"{side}_price")
        found &= (price < high) & (price >= low if low is not None else F.lit(True))
    for c, v in region.items():
        if v is not None:
            found &= F.col(c) == v
    return found


@query("p6_band_filter", f"{ITEMS} select 'own' as which, complex_id from stored where band_key = 4 union all select 'other', complex_id from stored where start_price >= 40000 and start_price < 50000 and sido_key = 2 union all select 'lowest', complex_id from stored where start_price < 10000")
def p6(spark, sf):
    rows = entity.shared_table(stored_items(spark, sf), "items")
    asked = {"own": band_filter("end", end_band=4), "other": band_filter("end", start_band=4, sido_key=2, dong_key=None), "lowest": band_filter("end", start_band=0)}
    found = [rows.where(w).select(F.lit(n).alias("which"), "complex_id") for n, w in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def bands_of(rows: DataFrame) -> DataFrame:
    """Bands made again from stored items: rounded means, growth as the ratio of means, the best item by name."""
    s, e = F.avg("start_pyeong"), F.avg("end_pyeong")
    best = F.struct(F.col("growth_rate").isNotNull(), "growth_rate", "growth_amount", "end_pyeong", -F.col("complex_id"))
    return rows.groupBy("band_key").agg(
        F.count("*").alias("complexes"), *(F.round(F.avg(c)).cast("int").alias(c) for c in ("start_price", "end_price", "start_pyeong", "end_pyeong")),
        F.round(e - s).cast("int").alias("growth_amount"), numbers.rounded(F.when(s != 0, (e - s) / s), 6).alias("growth_rate"), F.max("growth_rate").alias("top_growth"), F.max_by("name", best).alias("top_name"),
    )


BANDS = "bands as (select band_key, cast(count(*) as bigint) as complexes, cast(round(avg(start_price)) as int) as start_price, cast(round(avg(end_price)) as int) as end_price, cast(round(avg(start_pyeong)) as int) as start_pyeong, cast(round(avg(end_pyeong)) as int) as end_pyeong, cast(round(avg(end_pyeong) - avg(start_pyeong)) as int) as growth_amount, round(case when avg(start_pyeong) <> 0 then (avg(end_pyeong) - avg(start_pyeong)) / avg(start_pyeong) end, 6) as growth_rate, max(growth_rate) as top_growth from stored group by 1), top as (select band_key, name as top_name from stored qualify row_number() over (partition by band_key order by growth_rate desc nulls last, growth_amount desc nulls last, end_pyeong desc nulls last, complex_id) = 1)"


@query("a22_bands_again", f"{ITEMS}, {BANDS} select bands.*, top_name from bands left join top using (band_key)")
def a22(spark, sf):
    return bands_of(stored_items(spark, sf))


@query("j14_bands_with_top", f"{ITEMS}, {BANDS} select band_key, complexes, top_name from bands left join top using (band_key)")
def j14(spark, sf):
    """The best item of a band comes out of the band's own aggregation: no join."""
    return bands_of(stored_items(spark, sf)).select("band_key", "complexes", "top_name")


def total_rows(header_count: int | None, bands: DataFrame, rows: DataFrame, basis: str, start_band: int | None = None, end_band: int | None = None, **region) -> DataFrame:
    """(total): the header's count if nothing is filtered, the band's if only the basis' band is, else a count of rows."""
    given = [v for v in region.values() if v is not None]
    own, other = (end_band, start_band) if basis == "end" else (start_band, end_band)
    if not given and own is None and other is None and header_count is not None:
        return rows.sparkSession.createDataFrame([(header_count,)], "total long")
    if not given and own is not None and other is None:
        return bands.where(F.col("band_key") == own).agg(F.coalesce(F.sum("complexes"), F.lit(0)).alias("total"))
    return rows.where(band_filter(basis, start_band, end_band, **region)).agg(F.count("*").alias("total"))


@query("a26_totals", f"{ITEMS} select 'all' as which, cast(count(*) as bigint) as total from stored union all select 'band', cast(count(*) as bigint) from stored where band_key = 4 union all select 'region', cast(count(*) as bigint) from stored where band_key = 4 and sido_key = 1")
def a26(spark, sf):
    rows = entity.shared_table(stored_items(spark, sf), "items")
    bands = bands_of(rows)
    asked = {"all": {}, "band": {"end_band": 4}, "region": {"end_band": 4, "sido_key": 1}}
    found = [total_rows(rows.count(), bands, rows, "end", **a).select(F.lit(n).alias("which"), "total") for n, a in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("j36_counterpart_bands", f"{ITEMS} select 'end' as basis, band_key, cast(count(*) as bigint) as complexes from stored group by 2 union all select 'start', cast(case when start_price / 10000 < 1 then 0 when start_price / 10000 < 10 then floor(start_price / 10000) else floor(start_price / 100000) * 10 end as int), cast(count(*) as bigint) from stored group by 2")
def j36(spark, sf):
    """The bands of a snapshot and those of its counterpart: the same keys, the other basis."""
    root = f"{shared(spark)}/pair-{uuid.uuid4().hex}"
    rows = entity.shared_table(stored_items(spark, sf), "items")
    for basis in ("start", "end"):
        mine = rows.withColumn("band_key", numbers.band_key(F.col(f"{basis}_price")))
        snapshots.save(spark, root, keys(basis), bands_of(mine), mine)
    found = []
    for basis in ("end", "start"):
        path = snapshots.exact(snapshots.headers(spark, root), **keys(basis)).first()["path"]
        found.append(spark.read.parquet(f"{path}/bands").select(F.lit(basis).alias("basis"), "band_key", "complexes"))
    return found[0].unionByName(found[1])


def shared(spark) -> str:
    return entity.shared_root(spark)


def keys(basis: str) -> dict:
    return {"source": "trades", "basis": basis, "start_month": START, "end_month": END, "area_band": "all", "min_households": 0}


@query("s19_save_snapshot", f"{ITEMS} select 'superseded' as status, cast(count(distinct band_key) as bigint) as bands, cast(count(*) as bigint) as items, cast(null as bigint) as read from stored union all select 'active', cast(count(distinct band_key) as bigint), cast(count(*) as bigint), cast(count(*) as bigint) from stored")
def s19(spark, sf):
    """Two snapshots of the same keys are written and checked; the second one takes the place of the first."""
    root = f"{shared(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = entity.shared_table(stored_items(spark, sf), "items")
    for _ in range(2):
        path = snapshots.save(spark, root, keys("end"), bands_of(rows), rows)
    read = spark.read.parquet(f"{path}/items").agg(F.count("*").alias("n")).scalar()
    return snapshots.headers(spark, root).select("status", F.col("band_count").alias("bands"), F.col("item_count").alias("items"), F.when(F.col("status") == "active", read).alias("read"))


@query("s38_backfill_ranks", more("heads", "select h.source, h.end_month, o.o_orderkey as item, cast(row_number() over (partition by h.source, h.end_month order by o.o_totalprice desc, o.o_orderkey) as int) as rank from heads h join orders o on o.o_orderpriority = h.source and strftime(o.o_orderdate, '%Y%m') = h.end_month where h.status = 'active' and h.snapshot_id % 3 <> 0"), base=False)
def s38(spark, sf):
    """Ranks of the active snapshots that have none yet (here: by their number), all in one pass."""
    have = b.headers(spark, sf).where("snapshot_id % 3 = 0").select("source", "end_month")
    need = b.headers(spark, sf).where("status = 'active'").select("source", "end_month").join(have, ["source", "end_month"], "left_anti")
    items = b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), months.of(F.col("o_orderdate")).alias("end_month"), F.col("o_orderkey").alias("item"), "o_totalprice").join(need, ["source", "end_month"], "left_semi")
    w = Window.partitionBy("source", "end_month").orderBy(F.col("o_totalprice").desc(), "item")
    return items.select("source", "end_month", "item", F.row_number().over(w).cast("int").alias("rank"))


# Headers


@query("j12_headers_with_bands", more("heads", "select h.snapshot_id, h.band_count, cast(coalesce(n, 0) as bigint) as stored from heads h left join (select o_orderpriority as source, strftime(o_orderdate, '%Y%m') as end_month, count(distinct o_custkey % 10) filter (o_orderstatus <> 'P') as n from orders group by 1, 2) using (source, end_month)"), base=False)
def j12(spark, sf):
    stored = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), months.of(F.col("o_orderdate")).alias("end_month")).agg(F.countDistinct(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 10)).alias("n"))
    return b.headers(spark, sf).join(stored, ["source", "end_month"], "left").select("snapshot_id", "band_count", F.coalesce("n", F.lit(0)).alias("stored"))


@query("j13_headers_by_level", more("heads", "select h.snapshot_id, " + ", ".join(f"cast(count(o.o_orderkey) filter (o.o_orderstatus = '{s}') as bigint) as {n}" for n, s in (("dong", "F"), ("sigungu", "O"), ("sido", "P"))) + " from heads h left join orders o on o.o_orderpriority = h.source and strftime(o.o_orderdate, '%Y%m') = h.end_month and h.status = 'active' group by 1"), base=False)
def j13(spark, sf):
    levels = {"dong": "F", "sigungu": "O", "sido": "P"}
    counts = b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("source"), months.of(F.col("o_orderdate")).alias("end_month")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(n) for n, s in levels.items()))
    h = b.headers(spark, sf).join(counts, ["source", "end_month"], "left")
    return h.select("snapshot_id", *(F.when(F.col("status") == "active", F.coalesce(n, F.lit(0))).otherwise(0).cast("long").alias(n) for n in levels))


@query("j24_latest_snapshot_items", more("heads", "with h as (select * from heads where status = 'active' order by end_month desc, updated_at desc, snapshot_id desc limit 1) select o_orderkey as item, h.snapshot_id from h join orders o on o.o_orderpriority = h.source and strftime(o.o_orderdate, '%Y%m') = h.end_month"), base=False)
def j24(spark, sf):
    """The newest header is one row, read first; its items are then a filter of their partition."""
    h = b.headers(spark, sf).where("status = 'active'").orderBy(F.col("end_month").desc(), F.col("updated_at").desc(), F.col("snapshot_id").desc()).first()
    o = b.table(spark, sf, "orders").withColumn("m", months.of(F.col("o_orderdate")))
    if h is None:
        return o.where("false").select(F.col("o_orderkey").alias("item"), F.col("o_orderkey").alias("snapshot_id"))
    return o.where((F.col("o_orderpriority") == h["source"]) & (F.col("m") == h["end_month"])).select(F.col("o_orderkey").alias("item"), F.lit(h["snapshot_id"]).alias("snapshot_id"))


@query("j27_nearest_period", more("heads", "with q as (select unnest([3, 6, 12, 36, 60]) as asked) select cast(asked as int) as asked, source, max(snapshot_id) as snapshot_id from (select q.asked, h.*, row_number() over (partition by q.asked, source order by abs(period_months - asked), end_month desc, updated_at desc) as rn from q join heads h on abs(h.period_months - q.asked) <= case when q.asked <= 12 then 2 else 6 end) where rn = 1 and source = '1-URGENT' group by 1, 2"), base=False)
def j27(spark, sf):
    h = b.headers(spark, sf).where("source = '1-URGENT'")
    return snapshots.nearest_period(h, (3, 6, 12, 36, 60)).select("asked", "source", "snapshot_id")


@query("j28_stale_fallback", more("heads", "select source, basis, end_month, snapshot_id from heads where source = '2-HIGH' and basis = 'end' and end_month <= '199803' and status = 'active' and band_count > 0 and item_count > 0 order by end_month desc, updated_at desc limit 1"), base=False)
def j28(spark, sf):
    return snapshots.as_of(b.headers(spark, sf), "199803", source="2-HIGH", basis="end").select("source", "basis", "end_month", "snapshot_id")


@query("a40_cache_overview", more("heads", "select cast(count(*) as bigint) as n, max(updated_at) as updated_at, min(end_month) as first_month, max(end_month) as last_month from heads"), base=False)
def a40(spark, sf):
    return b.headers(spark, sf).agg(F.count("*").alias("n"), F.max("updated_at").alias("updated_at"), F.min("end_month").alias("first_month"), F.max("end_month").alias("last_month"))


@query("a41_collection_summary", "select o_orderpriority as target, o_orderstatus as status, cast(count(*) as bigint) as n, min(strftime(o_orderdate, '%Y%m')) as first_month, max(strftime(o_orderdate, '%Y%m')) as last_month from orders group by 1, 2", base=False)
def a41(spark, sf):
    m = months.of(F.col("o_orderdate"))
    return b.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min(m).alias("first_month"), F.max(m).alias("last_month"))


@query("t10_stale_headers", more("heads", "select snapshot_id, coalesce(updated_at < timestamp '1998-06-01' - interval 36 hour, true) as stale, coalesce(updated_at >= timestamp '1998-06-01' - interval 24 hour, false) as cached from heads"), base=False)
def t10(spark, sf):
    now = F.lit("1998-06-01").cast("timestamp_ntz")
    at = F.col("updated_at").cast("timestamp_ntz")
    return b.headers(spark, sf).select("snapshot_id", snapshots.stale(at, now, 36).alias("stale"), (~snapshots.stale(at, now, 24)).alias("cached"))


# Trades as they come


def responses(spark, sf) -> DataFrame:
    """Line items as XML responses, one for each order, with escaped names, commas in numbers, and either name of a tag;
    `lines` are their line numbers in the order of the items."""
    name = F.concat(F.lit("A&amp;B &lt;"), F.col("l_partkey").cast("string"), F.lit("&gt; "))
    part = lambda t, v: F.concat(F.lit(f"<{t}>"), v, F.lit(f"</{t}>"))
    odd, kind = F.col("l_linenumber") % 2 == 1, F.concat(F.lit("t"), (F.col("l_suppkey") % 3).cast("string"))
    more = F.concat(part("buildYear", (F.col("l_suppkey") % 60 + 1960).cast("string")), part("cdealType", F.when(F.col("l_returnflag") == "R", "O").otherwise("")), F.when(odd, part("dealingGbn", kind)).otherwise(part("거래유형", kind)), part("buyerGbn", F.col("l_returnflag")), F.when(odd, F.concat(part("sggCd", F.col("l_suppkey").cast("string")), part("unknownTag", F.lit("x")))).otherwise(""))
    item = F.concat(F.lit("<item>"), part("dealAmount", F.format_number(F.floor("l_extendedprice"), 0)), part("excluUseAr", F.col("l_quantity").cast("int").cast("string")), part("dealDay", F.dayofmonth("l_shipdate").cast("string")), F.when(F.col("l_partkey") % 2 == 0, part("aptNm", name)).otherwise(part("아파트", name)), part("floor", F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linenumber").cast("string"))), more, F.lit("</item>"))
    in_order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("x"))))
    body = F.array_join(F.transform(in_order, lambda s: s["x"]), "")
    xml = F.concat(F.lit("<response><header><resultCode>000</resultCode></header><body><items>"), body, F.lit("</items><totalCount>"), F.count("*").cast("string"), F.lit("</totalCount></body></response>"))
    return b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("lawd")).agg(xml.alias("xml"), F.min(months.of(F.col("l_shipdate"))).alias("deal_month"), F.transform(in_order, lambda s: s["l_linenumber"]).alias("lines"))


RAW = "raw as (select l_orderkey as lawd, min(strftime(l_shipdate, '%Y%m')) over (partition by l_orderkey) as deal_month, cast(floor(l_extendedprice) as bigint) as amount, cast(l_quantity as int) as m2, day(l_shipdate) as day, 'A&B <' || l_partkey || '>' as name, case when l_linenumber % 3 = 0 then null else l_linenumber end as floor from lineitem)"


@query("s9_parse_trades", f"with {RAW} select lawd, cast(count(*) as bigint) as items, max(name) as name, cast(sum(length(amount::varchar)) + sum(case when amount > 999 then 1 else 0 end) as bigint) as digits from raw group by 1", base=False)
def s9(spark, sf):
    found = trades.parse_trades(responses(spark, sf))
    name = F.trim(F.coalesce(F.col("item")["aptNm"], F.col("item")["아파트"]))
    return found.groupBy("lawd").agg(F.count("*").alias("items"), F.max(name).alias("name"), F.sum(F.length(F.col("item")["dealAmount"])).alias("digits"))


@query("s10_normalise_trades", f"with {RAW} select lawd, deal_month, amount, cast(m2 as double) as m2, cast(floor(amount / (m2 / 3.305785::double) + 0.5) as bigint) as pyeong, cast(day as bigint) as day, name, cast(floor as bigint) as floor, 'deal:' || sha1('trades|' || lawd || '|' || deal_month || '|' || day || '|' || name || '||||' || coalesce(cast(floor as varchar), '') || '|' || m2 || '|' || amount || '|') as deal_id from raw", base=False)
def s10(spark, sf):
    return trades.normalise(trades.parse_trades(responses(spark, sf))).select("lawd", "deal_month", "amount", "m2", "pyeong", "day", "name", "floor", "deal_id")


@query("s10_all_fields", "select l_orderkey as lawd, cast(l_linenumber as int) as line, case when l_linenumber % 2 = 1 then cast(l_suppkey as varchar) else cast(l_orderkey as varchar) end as sgg_code, l_suppkey % 60 + 1960 as build_year, case when l_returnflag = 'R' then 'O' else '' end as cancel_type, '' as cancel_day, 't' || (l_suppkey % 3) as dealing_type, '' as agent, l_returnflag as buyer, '' as seller, case when l_linenumber % 2 = 1 then 'x' end as unknown from lineitem", base=False)
def s10_fields(spark, sf):
    """The fields of a deal that s10 doesn't show; tags without a field stay in the raw item."""
    pages = trades.parse_pages(responses(spark, sf))
    # Outer: a plain posexplode filters on the size of its array, below the parser, and so parses everything again.
    numbered = pages.select("lawd", "deal_month", "lines", F.posexplode_outer("items").alias("at", "item")).where("item is not null")
    shown = trades.normalise(numbered.withColumn("line", F.get("lines", F.col("at")).cast("int")), keep=["line"])
    return shown.select("lawd", "line", "sgg_code", "build_year", "cancel_type", "cancel_day", "dealing_type", "agent", "buyer", "seller", F.get_json_object("raw", "$.unknownTag").alias("unknown"))


@query("s9_page_totals", "select l_orderkey as lawd, cast(count(*) as bigint) as total_count, cast(count(*) as int) as fetched, true as complete from lineitem group by 1", base=False)
def s9_totals(spark, sf):
    """What a response says there is against what it brought."""
    return trades.parse_pages(responses(spark, sf)).select("lawd", "total_count", F.size("items").alias("fetched"), (F.size("items") >= F.col("total_count")).alias("complete"))


@query("s14_flatten_quotes", "select l_suppkey as apt_id, cast(l_linenumber as int) as type_id, strftime(l_shipdate, '%Y%m') as month, cast(floor(l_extendedprice) as bigint) as price, cast(floor(floor(l_extendedprice) / (l_quantity / 3.305785::double) + 0.5) as bigint) as pyeong from lineitem where l_quantity > 5 and l_extendedprice >= 2000", base=False)
def s14(spark, sf):
    """Nested markers become apartments, types and monthly prices."""
    li = b.table(spark, sf, "lineitem")
    price = F.when(F.col("l_extendedprice") >= 2000, F.floor("l_extendedprice").cast("long"))
    one = F.struct(F.col("l_linenumber").cast("int").alias("type_id"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("m2"), F.array(F.struct(months.of(F.col("l_shipdate")).alias("month"), price.alias("price"))).alias("prices"))
    markers = li.select(F.col("l_suppkey").alias("id"), F.lit("x").alias("name"), F.array(one).alias("types"))
    return trades.flatten_quotes(markers)[2].select("apt_id", "type_id", "month", "price", "pyeong")


@query("s6_json_dataset", "select n_nationkey, n_name, n_regionkey from nation", base=False)
def s6(spark, sf):
    """A document of JSON is written and read again."""
    path = f"{shared(spark)}/json-{uuid.uuid4().hex}"
    b.table(spark, sf, "nation").write.json(path)
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query("s17_fetch_ledger", "select l_orderkey as target, arg_max(case l_returnflag when 'R' then 'failed' when 'A' then 'completed' else 'started' end, (l_shipdate, l_linenumber, l_partkey)) as status, cast(count(*) as bigint) as states from lineitem group by 1", base=False)
def s17(spark, sf):
    """Every change of state is appended; the newest of a key counts."""
    q = b.queue(spark, sf)
    state = F.when(F.col("status") == "pending", "started").otherwise(F.col("status"))
    log = q.select(F.col("job_id").alias("target"), state.alias("status"), F.struct("updated_at", "item", "source_id").alias("at"))
    return snapshots.latest_state(log, ["target"], "at").join(log.groupBy("target").agg(F.count("*").alias("states")), "target").select("target", "status", "states")


@query("s18_import_and_stale", "select s_suppkey, s_nationkey, 2 as imported_at from supplier where s_nationkey % 3 = 0 union all select s_suppkey, s_nationkey, 1 from supplier where s_nationkey % 3 = 1", base=False)
def s18(spark, sf):
    """A full import of some regions: their rows are replaced, what it didn't bring of region 2 goes, others stay."""
    s = b.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return snapshots.refresh(s.withColumn("imported_at", F.lit(1)), s.where("s_nationkey % 3 = 0"), ["s_suppkey"], F.lit(2), F.col("s_nationkey") % 3 == 2)


@query("s39_rebuild", "select p_partkey, regexp_replace(lower(p_name), '[^0-9a-z가-힣]', '', 'g') as key from part where p_size % 2 = 1", base=False)
def s39(spark, sf):
    """A derived table is made anew from its filtered source."""
    from ridgeline.functions.text import name_key

    return entity.shared_table(b.table(spark, sf, "part").where("p_size % 2 = 1").select("p_partkey", name_key(F.col("p_name")).alias("key")), "normalised")


@query("s23_cache_entry", "select r_regionkey, r_name from region", base=False)
def s23(spark, sf):
    """The second read comes from the stored entry: its builder would raise."""
    path = f"{shared(spark)}/cache-{uuid.uuid4().hex}"
    snapshots.cached(spark, path, "regions", lambda: b.table(spark, sf, "region"))
    return snapshots.cached(spark, path, "regions", lambda: spark.sql("select raise_error('not cached')"))


@query("s24_run_log", "select 3 as run union all select 2", base=False)
def s24(spark, sf):
    path = f"{shared(spark)}/runs-{uuid.uuid4().hex}"
    for i in (1, 2, 3):
        snapshots.log_run(spark.createDataFrame([(i,)], "run int").coalesce(1), path)
    return snapshots.last_runs(spark, path, 2).select("run")


@query("s31_static_lookup", "select cast(n_regionkey as int) as k, case n_regionkey when 0 then 'south' when 2 then 'east' else 'other' end as side, cast(count(*) as bigint) as n from nation group by 1, 2", base=False)
def s31(spark, sf):
    """A small list of values as a broadcast table."""
    sides = F.broadcast(spark.createDataFrame([(0, "south"), (2, "east")], "k int, side string"))
    rows = b.table(spark, sf, "nation").select(F.col("n_regionkey").cast("int").alias("k")).join(sides, "k", "left")
    return rows.groupBy("k", F.coalesce("side", F.lit("other")).alias("side")).agg(F.count("*").alias("n"))


# Jobs and their queue


@query("w6_latest_jobs", more("jobs", "select region, years_back, job_id, status from jobs qualify row_number() over (partition by region, years_back order by created_at desc, job_id desc) = 1"), base=False)
def w6(spark, sf):
    j = b.jobs(spark, sf)
    return j.groupBy("region", "years_back").agg(F.max_by(F.struct("job_id", "status"), F.struct("created_at", "job_id")).alias("s")).select("region", "years_back", "s.*")


@query("p23_tracked_jobs", more("jobs", "select job_id from jobs where region in (1, 4, 7) and (status in ('requested', 'running') or years_back in (1, 3) or created_at >= timestamp '1998-07-25')"), base=False)
def p23(spark, sf):
    recent = F.col("created_at") >= F.lit("1998-08-01").cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(7))
    return b.jobs(spark, sf).where(F.col("region").isin(1, 4, 7) & (F.col("status").isin("requested", "running") | F.col("years_back").isin(1, 3) | recent)).select("job_id")


LABELS = "labels as (select q.job_id, coalesce(nullif(q.dong, ''), nullif(p.p_brand, 'Brand#1'), 'region ' || j.region) as label from queue q join jobs j using (job_id) left join part p on p.p_partkey = q.source_id where q.status = 'completed')"


def labels(spark, sf) -> DataFrame:
    """Done items of the queue with the first label that isn't empty: the marker's, the stored one, the job's region."""
    q = b.queue(spark, sf).where("status = 'completed'").select("job_id", "source_id", F.get_json_object("marker", "$.dong").alias("dong"))
    stored = b.table(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), "p_brand")
    found = q.join(b.jobs(spark, sf).select("job_id", "region"), "job_id").join(stored, "source_id", "left")
    return found.select("job_id", F.coalesce(F.nullif("dong", F.lit("")), F.nullif("p_brand", F.lit("Brand#1")), F.concat(F.lit("region "), F.col("region").cast("string"))).alias("label"))


@query("j25_queue_labels", more("jobs queue", f"with {LABELS} select job_id, label, cast(count(*) as bigint) as n from labels group by 1, 2"), base=False)
def j25(spark, sf):
    return labels(spark, sf).groupBy("job_id", "label").agg(F.count("*").alias("n"))


@query("w14_top_labels", more("jobs queue", f"with {LABELS}, n as (select job_id, label, count(*) as n from labels group by 1, 2) select job_id, string_agg(label, ',' order by n desc, label) as labels from (select * from n qualify row_number() over (partition by job_id order by n desc, label) <= 3) group by 1"), base=False)
def w14(spark, sf):
    n = labels(spark, sf).groupBy("job_id", "label").agg(F.count("*").alias("n"))
    top = ranks.first_by(n, ["job_id"], [F.col("n").desc(), F.col("label").asc()], 3)
    return top.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "label"))), lambda s: s["label"]), ",").alias("labels"))


@query("p28_queue_details", more("queue", "select job_id, item, source_id, pyeong, status from queue where status <> 'none' order by case status when 'running' then 0 when 'failed' then 1 when 'pending' then 2 when 'completed' then 3 else 4 end, updated_at desc, job_id desc, item desc, source_id desc limit 200"), base=False)
def p28(spark, sf):
    return details(b.queue(spark, sf))


def details(queue: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Items of a status, if one is given, with fields of their marker; failed ones first, then by change."""
    rows = queue.where(F.col("status") == status) if status else queue
    order = F.when(F.col("status") == "running", 0).when(F.col("status") == "failed", 1).when(F.col("status") == "pending", 2).when(F.col("status") == "completed", 3).otherwise(4)
    first = rows.orderBy(order, *(F.col(c).desc() for c in ("updated_at", "job_id", "item", "source_id"))).limit(max(1, min(limit, 500)))
    return first.select("job_id", "item", "source_id", F.get_json_object("marker", "$.pyeong").cast("int").alias("pyeong"), "status")


PROGRESS = "progress as (select region, count(*) filter (q.status = 'completed') as done, count(*) filter (q.status = 'failed') as failed, count(*) filter (q.status = 'pending') as pending, count(*) as total from queue q join jobs j using (job_id) where j.status = 'running' group by 1)"


@query("a32_progress", more("jobs queue", f"with {PROGRESS} select r.region, cast(coalesce(total, 0) as bigint) as total, floor(done / nullif(done + pending + failed, 0) * 1000 + 0.5) / 10 as stored_percent, floor((done + failed) / nullif(total, 0) * 1000 + 0.5) / 10 as progress_percent from (select distinct region from jobs) r left join progress using (region)"), base=False)
def a32(spark, sf):
    """Per region how far its running jobs are; unknown where there is nothing to do."""
    j, q = b.jobs(spark, sf), b.queue(spark, sf).select("job_id", F.col("status").alias("state"))
    n = j.where("status = 'running'").select("job_id", "region").join(q, "job_id").groupBy("region").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "pending")), F.count("*").alias("total"))
    percent = lambda x, of: numbers.js_round(F.when(of != 0, x / of) * 1000) / 10
    done, failed, pending = (F.col(c) for c in ("completed", "failed", "pending"))
    rows = j.select("region").distinct().join(n, "region", "left")
    return rows.select("region", F.coalesce("total", F.lit(0)).alias("total"), percent(done, done + pending + failed).alias("stored_percent"), percent(done + failed, F.col("total")).alias("progress_percent"))


@query("a10_all_complete", more("jobs", "select region, bool_and(status = 'completed') as complete, bool_and(status <> 'requested') and sum(total) > 0 as started from jobs group by 1"), base=False)
def a10(spark, sf):
    return b.jobs(spark, sf).groupBy("region").agg(F.bool_and(F.col("status") == "completed").alias("complete"), (F.bool_and(F.col("status") != "requested") & (F.sum("total") > 0)).alias("started"))


# Prices as they are served


@query("j3_quote_chain", "select c.sigungu_key, m.type_id, m.month, cast(count(*) as bigint) as quotes, cast(floor(avg(m.price) + 0.5) as bigint) as price from monthly m join (select complex_id, type_id, min(m2) as m2 from deals group by 1, 2) t using (complex_id, type_id) join complexes c using (complex_id) where t.m2 > 1 group by 1, 2, 3")
def j3(spark, sf):
    """Monthly prices with their types and complexes."""
    deals = b.deals(spark, sf)
    types = deals.groupBy("complex_id", "type_id").agg(F.min("m2").alias("m2")).where("m2 > 1")
    rows = prices.monthly(deals).join(types, ["complex_id", "type_id"]).join(b.complexes(spark, sf).select("complex_id", "sigungu_key"), "complex_id")
    return rows.groupBy("sigungu_key", "type_id", "month").agg(F.count("*").alias("quotes"), numbers.js_round(F.avg("price")).alias("price"))


@query("j20_lookups", "select e.complex_id, e.type_id, c.name, coalesce(r.n, 0) as recent from ends e left join complexes c using (complex_id) left join (select complex_id, type_id, cast(count(*) as bigint) as n from deals where month = '200006' group by 1, 2) r using (complex_id, type_id)")
def j20(spark, sf):
    """What was a look-up in a map is a left join."""
    deals = b.deals(spark, sf)
    recent = deals.where("month = '200006'").groupBy("complex_id", "type_id").agg(F.count("*").alias("n"))
    rows = ends(prices.monthly(deals)).join(b.complexes(spark, sf).select("complex_id", "name"), "complex_id", "left").join(recent, ["complex_id", "type_id"], "left")
    return rows.select("complex_id", "type_id", "name", F.coalesce("n", F.lit(0)).alias("recent"))


@query("a20_quote_bands", "with t as (select complex_id, type_id, arg_min(price, month) filter (month >= '199606') as sp, min(month) filter (month >= '199606') as sm, arg_max(price, month) filter (month <= '200006') as ep, max(month) filter (month <= '200006') as em, arg_min(pyeong, month) filter (month >= '199606') as spy, arg_max(pyeong, month) filter (month <= '200006') as epy from monthly group by 1, 2), c as (select complex_id, avg(sp) as sp, avg(ep) as ep, avg(spy) as spy, avg(epy) as epy from t where sm <= em group by 1), g as (select *, cast(case when ep / 10000 < 1 then 0 when ep / 10000 < 10 then floor(ep / 10000) else floor(ep / 100000) * 10 end as int) as band_key from c) select band_key, cast(count(*) as bigint) as complexes, cast(floor(avg(sp) + 0.5) as bigint) as start_price, cast(floor(avg(ep) + 0.5) as bigint) as end_price, round(avg(epy) / avg(spy) - 1, 6) as growth_rate from g group by 1")
def a20(spark, sf):
    """Bands of quotes: per type the first price from the start on and the last up to the end, per complex their means."""
    m = bound_monthly(spark, sf)
    late, early = F.col("month") >= START, F.col("month") <= END
    pick = lambda ok, c, f: f(F.when(ok, F.struct("month", *c)))
    t = m.groupBy("complex_id", "type_id").agg(pick(late, ("price", "pyeong"), F.min).alias("s"), pick(early, ("price", "pyeong"), F.max).alias("e")).where("s.month <= e.month")
    c = t.groupBy("complex_id").agg(*(F.avg(f"{x}.{y}").alias(f"{x}_{y}") for x in "se" for y in ("price", "pyeong")))
    g = c.withColumn("band_key", numbers.band_key(F.col("e_price")))
    return g.groupBy("band_key").agg(F.count("*").alias("complexes"), numbers.js_round(F.avg("s_price")).alias("start_price"), numbers.js_round(F.avg("e_price")).alias("end_price"), numbers.rounded(numbers.growth(F.avg("s_pyeong"), F.avg("e_pyeong")), 6).alias("growth_rate"))


@query("a39_deal_counts", "select m.complex_id, m.type_id, cast(coalesce(nullif(case when m.type_id = 1 then t.n else 0 end, 0), m.n) as bigint) as deals from (select complex_id, type_id, sum(deals) as n from monthly group by 1, 2) m join (select complex_id, count(*) as n from deals group by 1) t using (complex_id)")
def a39(spark, sf):
    """The total where one is given (here: to the first type), else the sum of the months."""
    deals = b.deals(spark, sf)
    m = prices.monthly(deals).groupBy("complex_id", "type_id").agg(F.sum("deals").alias("n"))
    t = deals.groupBy("complex_id").agg(F.count("*").alias("all"))
    total = F.when(F.col("type_id") == 1, F.col("all")).otherwise(0)
    return m.join(t, "complex_id").select("complex_id", "type_id", F.coalesce(F.nullif(total, F.lit(0)), "n").alias("deals"))


@query("p24_served_items", "select complex_id, coalesce(name, '') as name, coalesce(growth_rate, 0) as growth_rate, cast(coalesce(types, 0) as int) as types, growth_rate is not null as has_data from complexes left join (select complex_id, growth_rate, types from items where growth_rate > 0) using (complex_id)")
def p24(spark, sf):
    """What is served has no nulls."""
    have = bound_items(spark, sf).where("growth_rate > 0").select("complex_id", "growth_rate", "types")
    rows = b.complexes(spark, sf).select("complex_id", "name").join(have, "complex_id", "left")
    return rows.select("complex_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("growth_rate", F.lit(0.0)).alias("growth_rate"), F.coalesce("types", F.lit(0)).alias("types"), F.col("growth_rate").isNotNull().alias("has_data"))


@query("p31_point_lookup", "select complex_id, name, sido_name, sigungu_name from complexes where complex_id = 7")
def p31(spark, sf):
    return b.complexes(spark, sf).where("complex_id = 7").select("complex_id", "name", "sido_name", "sigungu_name")


@query("p32_detail", "select type_id, string_agg(month || ':' || price, ',' order by month) as prices, cast(count(distinct month) as int) as months from monthly where complex_id = 7 group by 1")
def p32(spark, sf):
    """The types of one complex with their prices by month."""
    m = prices.monthly(b.deals(spark, sf).where("complex_id = 7"))
    listed = F.array_sort(F.collect_list(F.struct("month", "price")))
    return m.groupBy("type_id").agg(F.array_join(F.transform(listed, lambda p: F.concat_ws(":", p["month"], p["price"].cast("string"))), ",").alias("prices"), F.countDistinct("month").cast("int").alias("months"))


@query("p34_filter_options", more("apts", "select region, dong, cast(count(*) as bigint) as n from apts where region in (3, 4) and dong <> '' group by 1, 2"), base=False)
def p34(spark, sf):
    return b.apartments(spark, sf).where(F.col("region").isin(3, 4) & (F.col("dong") != "")).groupBy("region", "dong").agg(F.count("*").alias("n"))


# Visitors


@query("p19_analytics_scope", "select event_name, cast(count(*) as bigint) as n from ev where ts >= (select max(ts) from ev) - interval 2 day and visitor_id % 10 <> 0 and k % 3 = 1 group by 1")
def p19(spark, sf):
    e = b.events(spark, sf)
    return analytics_scope(e, e.agg(F.max("ts")).scalar(), 2, internal=F.col("visitor_id") % 10 == 0, environment=F.col("k") % 3 == 1).groupBy("event_name").agg(F.count("*").alias("n"))


def analytics_scope(events: DataFrame, now, days: int, internal=None, environment=None) -> DataFrame:
    """The last days (1 to 365), without internal visitors and of one environment where asked."""
    rows = events.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(max(1, min(days, 365)))))
    if internal is not None:
        rows = rows.where(~F.coalesce(internal, F.lit(False)))
    return rows if environment is None else rows.where(environment)


@query("t5_internal_visitors", "select event_name, k % 2 = 1 or visitor_id % 7 = 0 as internal, cast(count(*) as bigint) as n from ev group by 1, 2")
def t5(spark, sf):
    """Marking a visitor internal holds for all past events: the marks are a table that is joined when events are read."""
    marks = b.events(spark, sf).where("visitor_id % 7 = 0").select("visitor_id").distinct()
    rows = with_marks(b.events(spark, sf).withColumn("internal", F.col("k") % 2 == 1), marks)
    return rows.groupBy("event_name", "internal").agg(F.count("*").alias("n"))


def with_marks(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Events whose visitor is marked are internal, whatever they were stored as."""
    m = marks.select("visitor_id", F.lit(True).alias("_marked"))
    return events.join(m, "visitor_id", "left").withColumn("internal", F.coalesce("_marked", F.lit(False)) | F.coalesce("internal", F.lit(False))).drop("_marked")


# All snapshots in one job

ALL_BANDS = f"""with per as (select * from (values (3, '200003', 1, 1), (6, '199912', 2, 2), (12, '199906', 3, 3), (36, '199706', 6, 3), (60, '199506', 12, 3)) t(period, start_month, gap_s, gap_e)),
newest as (select complex_id, type_id, max(month) as month, round(avg(amount)) as price, round(avg(pyeong)) as pyeong from deals where deal_date between date '{TODAY}' - 30 and date '{TODAY}' group by 1, 2),
at_end as (select complex_id, type_id, max(month) as month, arg_max(price, month) as price, arg_max(pyeong, month) as pyeong from monthly where month <= '{END}' group by 1, 2),
at_start as (select complex_id, type_id, period, start_month, gap_s, gap_e, max(month) as month, arg_max(price, month) as start_price, arg_max(pyeong, month) as start_pyeong from monthly join per on month <= start_month group by 1, 2, 3, 4, 5, 6),
lagging as (select s.*, coalesce(n.price, e.price) as end_price, coalesce(n.pyeong, e.pyeong) as end_pyeong, coalesce(n.month, e.month) as end_month, s.type_id * 40 - 15 as m2 from at_start s join at_end e using (complex_id, type_id) left join newest n using (complex_id, type_id)),
fresh as (select *, m2 / 3.305785 as size from lagging where (cast(start_month[1:4] as int) - cast(month[1:4] as int)) * 12 + cast(start_month[5:6] as int) - cast(month[5:6] as int) between 0 and gap_s
  and ({END[:4]} - cast(end_month[1:4] as int)) * 12 + {int(END[4:])} - cast(end_month[5:6] as int) between 0 and gap_e and start_price <> 0 and start_pyeong <> 0 and end_price <> 0 and end_pyeong <> 0),
sized as (select *, unnest(['all', case when size <= 10 then 'under10' when size >= 60 then '60plus' else cast(cast(floor(size / 10) * 10 as int) as varchar) end]) as area_band, end_price - start_price as growth_amount, (end_price - start_price) / start_price as growth_rate from fresh),
best as (select * from sized qualify row_number() over (partition by complex_id, period, area_band order by growth_rate desc, growth_amount desc, end_price desc, m2) = 1),
kinds as (select * from (values ('start', 0), ('start', 100), ('end', 0), ('end', 100)) t(basis, min_households)),
every as (select best.*, name, sido_key, sigungu_key, basis, min_households, case when basis = 'end' then end_price else start_price end as price from best join complexes using (complex_id), kinds where coalesce(households, 0) >= min_households),
ranked as (select *, case when price / 10000 < 1 then 0 when price / 10000 < 10 then floor(price / 10000) else floor(price / 100000) * 10 end as band_key from every)"""


def all_snapshots(spark, sf, root: str) -> str:
    """Every snapshot of the deals as they stand at END, stored under root; types are of 25, 65, 105, 145 or 185 m2."""
    deals = b.deals(spark, sf).withColumn("m2", F.col("type_id") * 40 - 15)
    items = bands.rankings(bands.summaries(deals, END, TODAY), b.complexes(spark, sf).select("complex_id", "name", "households", "sido_key", "sigungu_key"))
    return bands.save_all(spark, root, items, END, starts=[months.shift(END, -p) for p in bands.PERIODS])


@query("a21_all_snapshots", f"{ALL_BANDS} select w.start_month, area_band, basis, cast(min_households as int) as min_households, case when count(complex_id) = 0 then 'skipped' else 'active' end as status, cast(count(distinct band_key) as bigint) as bands, cast(count(complex_id) as bigint) as items from (select start_month, basis, min_households, unnest(['all', 'under10', '10', '20', '30', '40', '50', '60plus']) as area_band from per, kinds) w left join ranked r using (start_month, area_band, basis, min_households) group by 1, 2, 3, 4")
def a21_all(spark, sf):
    """Periods x size bands x bases x household limits from one read of the deals: 160 snapshots active at once."""
    root = f"{shared(spark)}/all-{uuid.uuid4().hex}"
    all_snapshots(spark, sf, root)
    return snapshots.headers(spark, root).select("start_month", "area_band", "basis", "min_households", "status", F.col("band_count").alias("bands"), F.col("item_count").alias("items"))


@query("a21_ranked_items", f"{ALL_BANDS} select start_month, area_band, basis, cast(min_households as int) as min_households, cast(band_key as int) as band_key, complex_id, type_id, round(growth_rate, 6) as growth_rate, cast(row_number() over (partition by start_month, area_band, basis, min_households, band_key order by growth_rate desc, growth_amount desc, end_pyeong desc, name, complex_id) as int) as rank from ranked")
def a21_items(spark, sf):
    """What is stored of all snapshots, by the full order."""
    path = all_snapshots(spark, sf, f"{shared(spark)}/items-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{path}/items")
    return rows.select(F.col("start_month").cast("string").alias("start_month"), "area_band", "basis", "min_households", "band_key", "complex_id", "type_id", numbers.rounded("growth_rate", 6).alias("growth_rate"), "rank")


@query("a21_stored_bands", f"{ALL_BANDS}, first as (select start_month, area_band, basis, min_households, band_key, name from ranked qualify row_number() over (partition by start_month, area_band, basis, min_households, band_key order by growth_rate desc, growth_amount desc, end_pyeong desc, name, complex_id) = 1) select start_month, area_band, basis, cast(min_households as int) as min_households, cast(band_key as int) as band_key, cast(count(*) as bigint) as complexes, cast(floor(avg(start_price) + 0.5) as int) as start_price, cast(floor(avg(end_price) + 0.5) as int) as end_price, round((avg(end_pyeong) - avg(start_pyeong)) / avg(start_pyeong), 6) as growth_rate, any_value(first.name) as top_name from ranked join first using (start_month, area_band, basis, min_households, band_key) group by 1, 2, 3, 4, 5")
def a21_bands(spark, sf):
    path = all_snapshots(spark, sf, f"{shared(spark)}/bands-{uuid.uuid4().hex}")
    rows = spark.read.parquet(f"{path}/bands")
    return rows.select(F.col("start_month").cast("string").alias("start_month"), "area_band", "basis", "min_households", "band_key", "complexes", "start_price", "end_price", numbers.rounded("growth_rate", 6).alias("growth_rate"), "top_name")


@query("a21_contract", f"{ALL_BANDS}, asked as (select period, start_month, s from per, (values (null), (2)) t(s)) select cast(a.period as int) as months, cast(s as int) as sido, cast(count(complex_id) as bigint) as total, least(count(complex_id), 10) as rows, count(distinct case when s is null then sido_key else sigungu_key end) as options, concat_ws(',', case when count(complex_id) = 0 then 'empty_rows' end, case when count(complex_id) = 0 then 'empty_region_options' end) as issues from asked a left join (select * from ranked where area_band = 'all' and basis = 'start' and min_households = 100) r on r.start_month = a.start_month and (s is null or sido_key = s) group by 1, 2")
def a21_contract(spark, sf):
    """Each period's national page and a province's must come from an active snapshot and hold rows and options."""
    root = f"{shared(spark)}/contract-{uuid.uuid4().hex}"
    all_snapshots(spark, sf, root)
    return bands.contract(spark, root, END, 2)


# The back-fill

FETCHED = "src as (select cast(n_nationkey as varchar) as code, strftime(l_shipdate, '%Y%m') as month, cast(floor(l_extendedprice) as bigint) as amount, l_linenumber from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey), tasks as (select cast(n_nationkey as varchar) as code, strftime(m, '%Y%m') as month, row_number() over (order by strftime(m, '%Y%m'), cast(n_nationkey as varchar)) as place from nation cross join (select unnest(generate_series(date '1997-01-01', date '1997-12-01', interval 1 month)) as m))"


def recorded(spark, sf) -> DataFrame:
    """Line items as recorded answers, one for each nation and month."""
    places = b.complexes(spark, sf).select(F.col("complex_id").alias("l_suppkey"), F.col("sigungu_key").cast("string").alias("code"))
    item = F.create_map(F.lit("dealAmount"), F.floor("l_extendedprice").cast("string"), F.lit("line"), F.col("l_linenumber").cast("string"))
    rows = b.table(spark, sf, "lineitem").join(places, "l_suppkey").withColumn("month", months.of(F.col("l_shipdate")))
    return rows.groupBy("code", "month").agg(F.collect_list(item).alias("items")).withColumn("total_count", F.size("items").cast("long"))


@query("t8_backfill", f"with {FETCHED} select t.code, t.month, case when place > 220 then 'pending' when t.code = '7' then 'failed' else 'completed' end as status, cast(coalesce(case when place <= 220 and t.code <> '7' then count(amount) filter (l_linenumber <> 3) end, 0) as bigint) as saved, cast(coalesce(case when place <= 220 and t.code <> '7' then sum(amount) filter (l_linenumber <> 3) end, 0) as bigint) as amount from tasks t left join src using (code, month) group by t.code, t.month, place")
def t8(spark, sf):
    """Two runs with a limit of 110 tasks each: the second goes on where the first stopped; one code's fetches fail, and
    the second run doesn't get to try them again."""
    from ridgeline.operators import backfill

    root = f"{shared(spark)}/backfill-{uuid.uuid4().hex}"
    tasks = backfill.plan(b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code")), [months.shift("199701", i) for i in range(12)])
    answers = entity.shared_table(recorded(spark, sf), "answers")

    def fetch(claimed: DataFrame) -> DataFrame:
        found = claimed.join(answers, ["code", "month"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<map<string, string>>")))
        return found.withColumn("error", F.when(F.col("code") == "7", "timeout"))

    backfill.run(spark, root, tasks, fetch, 110, keep=lambda items: items.where("item['line'] <> '3'"))
    backfill.run(spark, root, tasks.join(backfill.ledger(spark, root).where("status = 'failed'").select("code", "month"), ["code", "month"], "left_anti"), fetch, 110, keep=lambda items: items.where("item['line'] <> '3'"))
    deals = backfill.stored(spark, root).groupBy("code", "month").agg(F.sum(F.col("item")["dealAmount"].cast("long")).alias("amount"))
    states = tasks.join(backfill.ledger(spark, root), ["code", "month"], "left").join(deals, ["code", "month"], "left")
    return states.select("code", "month", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("amount", F.lit(0)).alias("amount"))


# Sitemaps

@query("s34_sitemap_xml", "select complex_id, '/apartments/trade:' || complex_id || '?n=' || min(name) || '&r=<' || any_value(sido_name) || '>' as path, case when complex_id % 5 > 0 then strftime(date '2000-06-15' - cast(complex_id % 5 as int), '%Y-%m-%d') end as lastmod, cast('0.7' as varchar) as priority from items group by complex_id")
def s34(spark, sf):
    """Addresses of all ranked complexes written as sitemaps and read back from the XML that the index names."""
    from ridgeline.sources import files

    files.register(spark)
    day = F.when(F.col("complex_id") % 5 > 0, F.date_format(F.date_sub(F.lit("2000-06-15").cast("date"), (F.col("complex_id") % 5).cast("int")), "yyyy-MM-dd"))
    rows = bound_items(spark, sf).select(F.concat(F.lit("/apartments/trade:"), F.col("complex_id").cast("string"), F.lit("?n="), "name", F.lit("&r=<"), "sido_name", F.lit(">")).alias("path"), day.alias("lastmod"), F.lit("0.7").alias("priority"))
    root = f"{shared(spark)}/sitemap-{uuid.uuid4().hex}"
    rows.write.format("sitemap").option("base", "https://example.org").mode("append").save(root)
    read = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string, priority string").load(files.sitemap_files(spark, root))
    return read.select(F.regexp_extract("loc", r"trade:(\d+)", 1).cast("long").alias("complex_id"), F.replace("loc", F.lit("https://example.org"), F.lit("")).alias("path"), "lastmod", "priority")

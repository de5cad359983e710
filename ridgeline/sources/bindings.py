"""The domain's tables: read from Parquet, or bound to the star schema that tests use.

A deal is a line item, a complex a supplier, an area type a tenth of its quantity; nations and regions are the
hierarchy; orders by nation, segment and priority are quotes; events are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import months


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deals(spark: SparkSession, sf_dir: str, cancelled: bool = False) -> DataFrame:
    """Valid deals; with cancelled=True all of them, flagged."""
    rows = table(spark, sf_dir, "lineitem")
    if not cancelled:
        # A deal without a flag was not cancelled; one needs an area and a price.
        rows = rows.where("(l_returnflag is null or l_returnflag <> 'R') and l_quantity > 0 and l_extendedprice is not null")
    amount = F.round("l_extendedprice").cast("int")
    out = rows.select(
        F.col("l_suppkey").alias("complex_id"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("type_id"),
        amount.alias("amount"),
        F.round(amount / F.col("l_quantity")).cast("int").alias("pyeong"),
        months.of(F.col("l_shipdate")).alias("month"),
        F.to_date("l_shipdate").alias("deal_date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("int").alias("line_no"),
        F.col("l_quantity").alias("m2"),
        *([(F.col("l_returnflag") == "R").alias("cancelled")] if cancelled else []),
    )
    return out


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    places = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    return s.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("complex_id"),
        F.col("s_name").alias("name"),
        F.floor("s_acctbal").cast("int").alias("households"),
        F.col("n_nationkey").cast("int").alias("sigungu_key"),
        F.col("n_name").alias("sigungu_name"),
        F.col("r_regionkey").cast("int").alias("sido_key"),
        F.col("r_name").alias("sido_name"),
        (F.col("n_nationkey") * 10 + k % 3).cast("int").alias("dong_key"),
        (F.lit(37.0) + (k * 7919 % 1000) / 10000).alias("lat"),
        (F.lit(127.0) + (k * 104729 % 1000) / 10000).alias("lng"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly quotes: a (nation, segment) is a complex, a priority its type."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").cast("int").alias("region"), F.col("c_mktsegment").alias("name"), F.col("o_orderpriority").alias("type_id"), months.of(F.col("o_orderdate")).alias("month")).agg(F.floor(F.avg(F.floor(F.col("o_totalprice")).cast("long")) + 0.5).cast("int").alias("price"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp (the session's zone should be UTC)."""
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("visitor_id"), F.col("event_type").alias("event_name"), F.col("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))


#: Made-up parts of addresses for the tests' star schema.
PROVINCES = ("서울특별시", "부산광역시", "경기", "전북특별자치도", "제주", "경북")
CODES = ("11", "26", "41", "45", "50", "99")
DISTRICTS = ("강남구", "수원시 팔달구", "화성시", "가평군", "읍내 가곡면")
DONGS = ("역삼동", "반송동", "", "석우동")


def apartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as apartments with legal codes and addresses, some without code, place or neighbourhood."""
    k = F.col("c_custkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    pad = lambda x: F.lpad(x.cast("string"), 3, "0")
    jibun = F.concat_ws("-", (k % 50 + 1).cast("string"), (k % 3).cast("string"))
    seen = k % 13 != 0
    return table(spark, sf_dir, "customer").select(
        k.alias("apt_id"),
        F.col("c_name").alias("name"),
        F.floor("c_acctbal").cast("int").alias("households"),
        F.col("c_nationkey").cast("int").alias("region"),
        F.when(k % 11 == 0, "").otherwise(F.concat(pick(CODES), pad(F.col("c_nationkey")), pad(k % 9), F.lit("00"))).alias("legal_code"),
        F.concat_ws(" ", pick(PROVINCES), pick(DISTRICTS), pick(DONGS), jibun).alias("address"),
        pick(DONGS).alias("dong"),
        jibun.alias("jibun"),
        F.when(seen, F.lit(37.0) + (k * 7919 % 1000) / 10000).alias("lat"),
        F.when(seen, F.lit(127.0) + (k * 104729 % 1000) / 10000).alias("lng"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as crawl jobs."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        (F.col("o_custkey") % 25).cast("int").alias("region"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("requested").alias("status"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("years_back"),
        F.col("o_orderdate").alias("created_at"),
        F.floor("o_totalprice").cast("long").alias("total"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the queue of jobs."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_linenumber").cast("int").alias("item"),
        F.col("l_partkey").alias("source_id"),
        F.when(flag == "R", "failed").when(flag == "A", "completed").otherwise("pending").alias("status"),
        F.col("l_shipdate").alias("updated_at"),
        F.to_json(F.struct(F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("dong"), (F.col("l_partkey") % 7).cast("string"))).alias("dong"), F.col("l_quantity").cast("int").alias("pyeong"))).alias("marker"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of orders by priority as snapshot headers: (source, basis, period, end month) with counts and status."""
    o = table(spark, sf_dir, "orders").withColumn("month", months.of(F.col("o_orderdate")))
    found = o.groupBy(F.col("o_orderpriority").alias("source"), F.col("month").alias("end_month")).agg(
        F.count("*").alias("item_count"), F.countDistinct(F.col("o_custkey") % 10).alias("band_count"), F.max("o_orderdate").alias("updated_at"), F.max("o_orderkey").alias("snapshot_id")
    )
    k = F.col("snapshot_id")
    return found.withColumns({
        "basis": F.when(k % 2 == 0, "start").otherwise("end"),
        "period_months": F.get(F.array(*map(F.lit, (3, 6, 12, 36, 60))), (k % 5).cast("int")),
        "status": F.when(k % 7 == 0, "building").when(k % 5 == 0, "superseded").otherwise("active"),
    })

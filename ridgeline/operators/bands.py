"""All price-band snapshots at once: every period, size band, basis and household limit from one read of the deals.

Deals become monthly prices with the sums of the last days beside them; one aggregation gives each type its end price
and its start price of each period; fresh ones are exploded to periods and size bands; the type that grew most stands
for its complex; bases and household limits are a literal table. The ranked items are written once, in partitions, the
bands are made from what was stored, and one append of headers makes all snapshots active at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import months, numbers
from ridgeline.operators import prices, ranks, snapshots

#: What is built by default.
PERIODS = (3, 6, 12, 36, 60)
BASES = ("start", "end")
HOUSEHOLDS = (0, 100)
AREA_BANDS = ("all", "under10", "10", "20", "30", "40", "50", "60plus")

#: What tells a snapshot of one batch from the others; items and bands are stored under these.
PARTS = ("start_month", "area_band", "basis", "min_households")


def summaries(deals: DataFrame, end_month: str, today: str, periods: Sequence[int] = PERIODS, days: int = 30) -> DataFrame:
    """complex_id, type_id, m2, period, start_month, start_price, start_pyeong, end_price, end_pyeong: types whose start
    and end are known and fresh, for each period.

    deals: complex_id, type_id, m2, month, deal_date, amount, pyeong; m2 is one of a type's. The end price is that of the
    last days up to `today` if there was a deal, else the last one at or before the month.
    """
    day = F.to_date(F.lit(today))
    now = F.col("deal_date").between(F.date_sub(day, days), day)
    monthly = deals.groupBy("complex_id", "type_id", "month").agg(
        F.min("m2").alias("m2"), prices.mean_int("amount").alias("price"), prices.mean_int("pyeong").alias("pyeong"),
        F.count(F.when(now, 1)).alias("n"), *(F.sum(F.when(now, F.col(c))).alias(f"sum_{c}") for c in ("amount", "pyeong")),
    )
    row = F.struct("month", "price", "pyeong")
    at = {p: months.shift(end_month, -p) for p in periods} | {0: end_month}
    carried = lambda t: F.max_by(row, F.when(F.col("month") <= t, F.col("month")))
    types = monthly.groupBy("complex_id", "type_id").agg(
        F.min("m2").alias("m2"), F.sum("n").alias("n"), F.max(F.when(F.col("n") > 0, F.col("month"))).alias("month"),
        *((F.sum(f"sum_{c}") / F.sum("n")).alias(c) for c in ("amount", "pyeong")), *(carried(t).alias(f"at{p}") for p, t in at.items()),
    )
    recent = F.when(F.col("n") > 0, F.struct("month", F.round("amount").cast("int").alias("price"), F.round("pyeong").cast("int").alias("pyeong")))
    known = lambda p: F.when(F.col(f"at{p}.month") <= at[p], F.col(f"at{p}"))
    gaps = {p: months.freshness(p) for p in periods}
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.lit(at[p]).alias("start_month"), known(p).alias("s"), *(F.lit(g).alias(n) for n, g in zip(("gap_s", "gap_e"), gaps[p], strict=True))) for p in periods)))
    rows = types.withColumn("e", F.coalesce(recent, known(0))).select("complex_id", "type_id", "m2", "e", each.alias("p"))
    lag = lambda source, target: months.between(F.col(source), target)
    fresh = lag("p.s.month", F.col("p.start_month")).between(0, F.col("p.gap_s")) & lag("e.month", F.lit(end_month)).between(0, F.col("p.gap_e"))
    there = reduce(lambda a, c: a & (F.col(c) != 0), ("p.s.pyeong", "e.price", "e.pyeong"), F.col("p.s.price") != 0)
    return rows.where(there & fresh).select("complex_id", "type_id", "m2", "p.period", "p.start_month", *(F.col(f"{s}.{c}").alias(f"{n}_{c}") for s, n in (("p.s", "start"), ("e", "end")) for c in ("price", "pyeong")))


def rankings(types: DataFrame, complexes: DataFrame, bases: Sequence[str] = BASES, households: Sequence[int] = HOUSEHOLDS, areas: Sequence[str] = AREA_BANDS, hidden: DataFrame | None = None) -> DataFrame:
    """The items of all snapshots with their rank in the price band; order: growth rate, amount, end price by pyeong, name
    in Korean order, then id.

    types: see summaries(); complexes: complex_id, name, households and what else an item shall carry; hidden
    (complex_id, min_households): duplicates that a household limit's snapshots leave out.
    """
    own = numbers.area_band(F.col("m2") / numbers.M2_PER_PYEONG)
    rate = (F.col("end_price") - F.col("start_price")) / F.col("start_price")
    rows = types.withColumns({"area_band": F.explode(F.array(F.lit("all"), own)), "growth_amount": F.col("end_price") - F.col("start_price"), "growth_rate": rate}).where(F.col("area_band").isin(*areas))
    row = F.struct("type_id", "m2", "start_price", "start_pyeong", "end_price", "end_pyeong", "growth_amount", "growth_rate")
    best = rows.groupBy("complex_id", "period", "start_month", "area_band").agg(F.max_by(row, F.struct("growth_rate", "growth_amount", "end_price", -F.col("m2"), -F.col("type_id"))).alias("best"), F.count("*").cast("int").alias("types"))
    kinds = F.explode(F.array(*(F.struct(F.lit(b).alias("basis"), F.lit(h).alias("min_households")) for b in bases for h in households)))
    items = best.join(complexes, "complex_id").select("*", kinds.alias("kind")).select("*", "kind.*", "best.*").drop("kind", "best")
    items = items.where(F.coalesce("households", F.lit(0)) >= F.col("min_households"))
    if hidden is not None:
        items = items.join(hidden, ["complex_id", "min_households"], "left_anti")
    items = items.withColumn("band_key", numbers.band_key(F.when(F.col("basis") == "end", F.col("end_price")).otherwise(F.col("start_price"))))
    return ranks.group_rank(items, [*PARTS, "band_key"], order(), "rank")


def order() -> list[Column]:
    """The full order of items: the id tells complexes of one name apart."""
    return [F.col("growth_rate").desc_nulls_last(), F.col("growth_amount").desc_nulls_last(), F.col("end_pyeong").desc_nulls_last(), F.collate(F.col("name"), "ko").asc_nulls_first(), F.col("complex_id").asc()]


def bands_of(items: DataFrame) -> DataFrame:
    """The bands of ranked items: rounded means, growth as the ratio of means, the first item's name and growth."""
    s, e = F.avg("start_pyeong"), F.avg("end_pyeong")
    return items.groupBy(*PARTS, "band_key").agg(
        F.count("*").alias("complexes"), *(numbers.js_round(F.avg(c)).cast("int").alias(c) for c in ("start_price", "end_price", "start_pyeong", "end_pyeong")),
        numbers.js_round(e - s).cast("int").alias("growth_amount"), F.when(s != 0, (e - s) / s).otherwise(0.0).alias("growth_rate"),
        F.min_by("growth_rate", "rank").alias("top_growth"), F.min_by("name", "rank").alias("top_name"),
    )


def save_all(spark: SparkSession, root: str, items: DataFrame, end_month: str, source: str = "trades", starts: Sequence[str] = (), bases: Sequence[str] = BASES, households: Sequence[int] = HOUSEHOLDS, areas: Sequence[str] = AREA_BANDS) -> str:
    """Stores items and their bands under a new folder of `root` and makes every filled snapshot active by one append.

    Until then all are `building` and readers see those before. A snapshot without items is logged as `skipped`; if the
    bands of one don't count its items, all fail and SnapshotError is raised.
    """
    path = f"{root}/data/{uuid.uuid4().hex}"
    wanted = spark.createDataFrame([(s, a, b, h) for s in starts for a in areas for b in bases for h in households], "start_month string, area_band string, basis string, min_households int")

    def log(states: DataFrame) -> None:
        row = states.select(F.lit(source).alias("source"), "basis", "start_month", F.lit(end_month).alias("end_month"), "area_band", "min_households", F.lit(path).alias("path"), "status", "band_count", "item_count", F.current_timestamp().alias("updated_at"))
        row.coalesce(1).write.mode("append").parquet(f"{root}/headers")

    none = F.lit(0).cast("long")
    log(wanted.withColumns({"status": F.lit("building"), "band_count": none, "item_count": none}))
    items.repartition(*PARTS, F.pmod(F.xxhash64("complex_id"), F.lit(8))).write.partitionBy(*PARTS).parquet(f"{path}/items")
    stored = stored_part(spark, path, "items", items.schema)
    bands_of(stored).write.partitionBy(*PARTS).parquet(f"{path}/bands")
    kept = spark.read.parquet(f"{path}/bands") if stored.limit(1).count() else bands_of(stored)
    parts = [F.col("start_month").cast("string").alias("start_month"), F.col("area_band").cast("string").alias("area_band"), "basis", "min_households"]
    counted = kept.select(*parts, "complexes").groupBy(*PARTS).agg(F.count("*").alias("band_count"), F.sum("complexes").alias("told"))
    counted = wanted.join(counted, list(PARTS), "left").join(stored.groupBy(*PARTS).agg(F.count("*").alias("item_count")), list(PARTS), "left").na.fill(0)
    states = counted.withColumn("status", F.when(F.col("item_count") == 0, "skipped").when(F.col("told") == F.col("item_count"), "active").otherwise("failed"))
    rows = states.select(*PARTS, "status", "band_count", "item_count").collect()  # a row for each snapshot asked for
    bad = [r for r in rows if r["status"] == "failed"]
    log(spark.createDataFrame([(*r[:4], "failed" if bad and r["status"] == "active" else r["status"], *r[5:]) for r in rows], states.select(*PARTS, "status", "band_count", "item_count").schema))
    if bad:
        raise snapshots.SnapshotError(f"bands of {len(bad)} snapshots don't count their items")
    return path


def stored_part(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def read(spark: SparkSession, header, name: str) -> DataFrame:
    """Items or bands of a header of save_all(): the partitions of its keys."""
    rows = spark.read.parquet(f"{header['path']}/{name}")
    return rows.where((F.col("start_month").cast("string") == header["start_month"]) & (F.col("area_band").cast("string") == header["area_band"]) & (F.col("basis") == header["basis"]) & (F.col("min_households") == header["min_households"]))


def contract(spark: SparkSession, root: str, end_month: str, sido: int, periods: Sequence[int] = PERIODS, size: int = 10, least: int = 100, basis: str = "start") -> DataFrame:
    """months, sido (null: all), total, rows (of the first page), options (regions to choose from), issues: what each
    period's page must hold, read from the active snapshots."""
    found = snapshots.headers(spark, root)
    pages = []
    for p in periods:
        header = snapshots.exact(found, basis=basis, start_month=months.shift(end_month, -p), end_month=end_month, area_band="all", min_households=least).first()
        for s, below in ((None, "sido_key"), (sido, "sigungu_key")):
            if header is None:
                pages.append(spark.range(1).select(F.lit(p).alias("months"), F.lit(s).cast("int").alias("sido"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("options"), F.lit(False).alias("hit")))
                continue
            rows = read(spark, header, "items")
            rows = rows if s is None else rows.where(F.col("sido_key") == s)
            pages.append(rows.agg(F.lit(p).alias("months"), F.lit(s).cast("int").alias("sido"), F.count("*").alias("total"), F.countDistinct(below).alias("options"), F.lit(True).alias("hit")))
    every = reduce(DataFrame.unionByName, pages)
    issue = lambda c, name: F.when(c, name)
    issues = F.concat_ws(",", issue(~F.col("hit"), "cache_miss"), issue(F.col("total") <= 0, "empty_rows"), issue(F.col("options") <= 0, F.when(F.col("sido").isNull(), "empty_sido_options").otherwise("empty_region_options")))
    return every.select("months", "sido", "total", F.least("total", F.lit(size)).alias("rows"), "options", issues.alias("issues"))

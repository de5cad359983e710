"""Trades as they come: XML responses and nested quotes, flattened and normalised with native functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.numbers import js_round, pyeong_price

#: The names a field goes by, the first that isn't empty counts.
FIELDS = {
    "sgg_code": ("sggCd", "지역코드"),
    "deal_year": ("dealYear", "년"),
    "month_of_year": ("dealMonth", "월"),
    "day": ("dealDay", "일"),
    "name": ("aptNm", "아파트"),
    "block": ("aptDong", "aptDongNm", "동"),
    "dong": ("umdNm", "법정동"),
    "jibun": ("jibun", "지번"),
    "floor": ("floor", "층"),
    "build_year": ("buildYear", "건축년도"),
    "m2": ("excluUseAr", "전용면적"),
    "amount": ("dealAmount", "거래금액"),
    "cancel_type": ("cdealType", "해제여부"),
    "cancel_day": ("cdealDay", "해제사유발생일"),
    "registered": ("rgstDate", "등기일자"),
    "dealing_type": ("dealingGbn", "거래유형"),
    "agent": ("estateAgentSggNm", "중개사소재지"),
    "buyer": ("buyerGbn", "매수자"),
    "seller": ("slerGbn", "매도자"),
}
WHOLE = ("deal_year", "month_of_year", "day", "floor", "build_year", "amount")
GOOD = ("00", "000")

#: A response as the XML parser reads it; items are maps, so tags that no field goes by are kept.
RESPONSE = "resultCode string, resultMsg string, header struct<resultCode: string, resultMsg: string>, body struct<items: struct<item: array<map<string, string>>>, totalCount: string>, items struct<item: array<map<string, string>>>, _bad string"


def parse_pages(responses: DataFrame, xml: str = "xml") -> DataFrame:
    """The other columns, total_count (null if none is told) and items array<map<string, string>>, parsed once.

    A response with a result code that isn't good raises, and so does one that isn't a response. One without items has
    an empty array.
    """
    rows = responses.withColumn("_r", F.from_xml(F.col(xml), RESPONSE, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    code = F.trim(F.coalesce("_r.header.resultCode", "_r.resultCode", F.lit("")))
    told = F.raise_error(F.concat_ws(" ", F.lit("result"), code, F.coalesce("_r.header.resultMsg", "_r.resultMsg")))
    other = F.raise_error(F.concat(F.lit("no response: "), F.coalesce(F.left(F.col(xml), F.lit(200)), F.lit("null"))))
    bad = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull() | ~F.contains(F.col(xml), F.lit("<response")), other).when(~code.isin("", *GOOD), told)
    items = F.coalesce("_r.body.items.item", "_r.items.item", F.array().cast("array<map<string, string>>"))
    # No filter: it would be pushed below the parser's column and parse everything again.
    return rows.select(*(c for c in responses.columns if c != xml), number(F.col("_r.body.totalCount")).cast("long").alias("total_count"), F.when(bad.isNull(), items).alias("items"))


def parse_trades(responses: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per item of each response: the other columns and item map<string, string>; see parse_pages()."""
    pages = parse_pages(responses, xml)
    return pages.select(*(c for c in pages.columns if c not in ("total_count", "items")), F.explode_outer("items").alias("item")).where("item is not null")


def number(x: Column) -> Column:
    # An empty text would be an exception inside the cast, which is slow.
    return F.nullif(F.replace(F.trim(x), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def normalise(items: DataFrame, source: str = "trades", keep: Sequence[str] = ()) -> DataFrame:
    """item maps as deals: fields by any of their names, numbers with commas, price per pyeong, the whole item as JSON, and
    an id that is the SHA-1 of what tells a deal. items: lawd, deal_month, item; its columns in `keep` stay. A deal without
    a district code has its response's."""
    # A map is searched from its start for every name, in so much generated code that the JVM doesn't compile it; its JSON
    # is read once, the known tags into a struct.
    known = ", ".join(f"`{n}` string" for of in FIELDS.values() for n in of)
    read = items.select("lawd", "deal_month", *keep, F.to_json("item").alias("raw")).withColumn("_known", F.from_json("raw", known))

    def pick(k: str) -> Column:
        found = F.coalesce(*(F.nullif(F.trim(F.col("_known")[n]), F.lit("")) for n in FIELDS[k]), F.lit(""))
        return number(found).cast("long") if k in WHOLE else number(found) if k == "m2" else found

    out = read.select("lawd", "deal_month", *keep, *(pick(k).alias(k) for k in FIELDS), "raw")
    out = out.withColumn("sgg_code", F.when(F.col("sgg_code") == "", F.col("lawd").cast("string")).otherwise(F.col("sgg_code")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    shown = F.when(F.col("m2") == F.floor("m2"), F.floor("m2").cast("string")).otherwise(text("m2"))
    key = F.concat_ws("|", F.lit(source), "lawd", "deal_month", text("day"), "name", "block", "dong", "jibun", text("floor"), F.coalesce(shown, F.lit("")), text("amount"), "registered")
    price = F.when((F.col("amount") != 0) & (F.col("m2") != 0), pyeong_price(F.col("amount"), F.col("m2")))
    return out.withColumns({"pyeong": price, "deal_id": F.concat(F.lit("deal:"), F.sha1(key))})


def flatten_quotes(markers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(apartments, area types, monthly prices) of markers: id, name, types array<struct<type_id, m2, prices
    array<struct<month, price>>>>. Types without an area and months without a price go."""
    types = markers.select(F.col("id").alias("apt_id"), F.explode("types").alias("t")).select("apt_id", "t.*").where("m2 > 0")
    prices = types.select("apt_id", "type_id", "m2", F.explode("prices").alias("p")).where("p.price > 0")
    monthly = prices.select("apt_id", "type_id", "p.month", "p.price", js_round(F.col("p.price") / (F.col("m2") / 3.305785)).alias("pyeong"))
    apartments = markers.select(F.col("id").alias("apt_id"), "name").join(types.select("apt_id").distinct(), "apt_id", "left_semi")
    return apartments, types.select("apt_id", "type_id", "m2"), monthly

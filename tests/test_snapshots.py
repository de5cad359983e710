"""Snapshots, caches and trades as they come: what must raise, and hand-computed cases."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ridgeline.operators import snapshots
from ridgeline.plans import all_queries
from ridgeline.plans.matching import hidden
from ridgeline.plans.serving import keys
from ridgeline.sources import trades


def test_a_bad_snapshot_leaves_the_active_one(spark, tmp_path):
    rows, none = spark.range(3), spark.range(0)
    path = snapshots.save(spark, str(tmp_path), keys("end"), rows, rows)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.save(spark, str(tmp_path), keys("end"), rows, none)
    found = snapshots.headers(spark, str(tmp_path))
    assert snapshots.exact(found, **keys("end")).first()["path"] == path
    assert sorted(r["status"] for r in found.collect()) == ["active", "failed"]


def test_cache_is_made_anew_when_old(spark, tmp_path):
    get = lambda n, hours: [r["n"] for r in snapshots.cached(spark, str(tmp_path), "k", lambda: spark.createDataFrame([(n,)], "n int"), hours).collect()]
    assert get(1, 24) == [1] and get(2, 24) == [1] and get(3, 0) == [3]


def test_responses(spark):
    xml = "<response><header><resultCode>00</resultCode></header><items><item><dealAmount> 1,234 </dealAmount><전용면적>33.05785</전용면적><aptNm>A &amp; B</aptNm></item></items></response>"
    rows = spark.createDataFrame([("11", "202401", xml)], "lawd string, deal_month string, xml string")
    r = trades.normalise(trades.parse_trades(rows)).first()
    assert (r["amount"], r["m2"], r["name"], r["pyeong"], r["floor"]) == (1234, 33.05785, "A & B", 123, None)
    for bad in ("<response><resultCode>22</resultCode></response>", "busy"):
        with pytest.raises(PySparkException):
            trades.parse_trades(rows.withColumn("xml", F.lit(bad))).collect()


@pytest.mark.parametrize("name", ["s10_normalise_trades", "s10_all_fields"])
def test_responses_are_parsed_once_by_compiled_code(spark, capsys, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = all_queries()[0][name](spark, "/root/testdata/sf0.001")
        df.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        df.explain()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert capsys.readouterr().out.count("from_xml(") == 1
    assert sizes and max(sizes) < 8000  # bytes, beyond which the JVM leaves a method to its interpreter


def test_all_names_of_a_field_and_odd_items(spark):
    item = {"aptNm": " ", "아파트": ' "A" \\ \n é ', "floor": "", "층": " -1 ", "dealAmount": "", "거래금액": "x", "전용면적": "1e1", "other": "{}"}
    rows = spark.createDataFrame([("11", "202401", item, 7), ("12", None, {}, 8)], "lawd string, deal_month string, item map<string, string>, line int")
    r, none = trades.normalise(rows, keep=["line"]).orderBy("lawd").collect()
    assert (r["name"], r["floor"], r["amount"], r["m2"], r["sgg_code"], r["line"]) == ('"A" \\ \n é', -1, None, 10.0, "11", 7)
    assert json.loads(r["raw"]) == item
    assert (none["name"], none["floor"], none["raw"], none["line"]) == ("", None, "{}", 8)


def test_hide_by_months_and_by_build_year(spark):
    rows = [(1, "new", "202406", 2010, 5), (1, "two years", "202206", 2009, 9), (1, "one year, old", "202306", 2000, 9), (1, "one year", "202306", 2005, 9), (1, "never", None, 1990, 0)]
    df = spark.createDataFrame(rows, "root int, name string, last_month string, built int, n long")
    found = {r["name"]: (r["survives"], r["hidden"]) for r in hidden(df).collect()}
    assert found == {"new": (True, False), "two years": (False, True), "one year, old": (False, True), "one year": (False, False), "never": (False, False)}

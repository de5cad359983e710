"""Edges of the functions and operators, on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo, months, numbers, text
from ridgeline.operators import entity, prices, ranks
from ridgeline.plans.matching import FORMULAS, predictions, tiles, trimmed_means


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def column(spark, xs, kind, c):
    return [r[0] for r in values(spark, [(x,) for x in xs], f"x {kind}", c)]


def test_bands(spark):
    assert column(spark, [9_999, 10_000, 99_999, 100_000, 199_999, 200_000], "int", numbers.band_key(F.col("x"))) == [0, 1, 9, 10, 10, 20]
    assert column(spark, [10.0, 10.01, 20.0, 60.0], "double", numbers.area_band(F.col("x"))) == ["under10", "10", "20", "60plus"]
    assert [numbers.band_range(k) for k in (0, 3, 20)] == [(None, 10_000), (30_000, 40_000), (200_000, 300_000)]


def test_rounding_and_percent(spark):
    assert column(spark, [-2.5, 2.5, 0.4], "double", numbers.js_round(F.col("x"))) == [-2, 3, 0]
    assert column(spark, [0.0004, -0.0004, 0.0051], "double", numbers.percent(F.col("x"))) == [0, 0, 0.5]
    assert column(spark, [0.0, -0.1, 0.05, 0.1, 0.25, None], "double", numbers.tone(F.col("x"))) == ["neutral", "negative", "top3", "top2", "top1", "neutral"]
    assert column(spark, ["1,234", " 7 ", "x", None], "string", numbers.parse_number(F.col("x"))) == [1234, 7, None, None]


def test_plan_time_rules():
    assert [numbers.zoom_level(z) for z in (10, 11, 13, 16)] == ["sido", "sigungu", "dong", "apartment"]
    assert (numbers.page_size(5), numbers.page_size(500), numbers.page_of(99, 25, 10), numbers.page_of(1, 0, 10)) == (10, 100, (3, 3), (1, 1))
    assert [months.freshness(p) for p in (3, 6, 12, 36, 60, float("nan"))] == [(1, 1), (2, 2), (3, 3), (6, 3), (12, 3), (12, 3)]
    assert [numbers.stored_years(y) for y in (0.25, 0.5, 1, 10)] == [0, 0, 1, 10] and months.shift("200001", -1) == "199912"


def test_months(spark):
    got = values(spark, [("202401", "202310"), ("202401", "202309"), ("202401", "202402")], "t string, s string", months.between(F.col("s"), F.col("t")), months.fresh(F.col("s"), F.col("t"), 3))
    assert got == [(3, True), (4, False), (-1, False)]
    assert values(spark, [("202311",)], "m string", months.add(F.col("m"), 3), months.span(F.col("m"), F.lit("202401"))) == [("202402", ["202311", "202312", "202401"])]


def test_text(spark):
    got = values(spark, [("abc", "abc"), ("abc", "ab"), ("", "a"), ("word", "world"), (None, "a")], "a string, b string", text.name_score(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [100, 90, 0, 38, 0]
    assert column(spark, ["래미안 (1단지) A.b", None], "string", text.name_key(F.col("x"))) == ["래미안1단지ab", ""]
    ua = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605 Version/17.0 Mobile/15E148 Safari/604.1"
    assert tuple(column(spark, [ua], "string", text.user_agent(F.col("x")))[0]) == ("Safari", "17.0", "iOS", "17.0", "mobile")
    hosts = ["localhost:3000", "https://dev.a.kr/x", "a.kr:443", "b.kr", "[::1]:80", "10.1.2.3", None]
    assert column(spark, hosts, "string", text.environment(F.col("x"), ("a.kr",), ("dev.a.kr",))) == ["local", "development", "production", "unknown", "local", "local", "unknown"]
    agents = {
        "Mozilla/5.0 (Linux; Android 13; SM-G991N) AppleWebKit/537.36 Chrome/110.0.1 Mobile Safari/537.36 KAKAOTALK/10.2.1": ("KakaoTalk", "10.2.1", "Android", "13", "mobile"),
        "Mozilla/5.0 (Windows NT 10.0; Win64) AppleWebKit/537.36 Chrome/118.0 Whale/3.23.2 Safari/537.36": ("Naver Whale", "3.23.2", "Windows", "10.0", "desktop"),
        "Mozilla/5.0 (compatible; Googlebot/2.1)": ("Unknown", "", "Unknown", "", "bot"),
        "Mozilla/5.0 (Linux; Android 12; SM-T870) AppleWebKit/537.36 Chrome/99.0 Safari/537.36": ("Chrome", "99.0", "Android", "12", "tablet"),
        "": ("Unknown", "", "Unknown", "", "desktop"),
    }
    assert [tuple(r) for r in column(spark, list(agents), "string", text.user_agent(F.col("x")))] == list(agents.values())
    assert column(spark, ["  __Click Me!! ", "!!!", None, "a.b:c"], "string", text.slug(F.col("x"))) == ["click_me", "page_view", "page_view", "a.b:c"]
    import hashlib
    import hmac

    from ridgeline.plans.places import hmac_sha256

    assert column(spark, ["x", ""], "string", hmac_sha256(F.col("x"), b"key")) == [hmac.new(b"key", m, hashlib.sha256).hexdigest() for m in (b"x", b"")]
    assert column(spark, ["6f9619ff-8b86-4d01-b42d-00cf4fc964ff", "x"], "string", text.is_uuid(F.col("x"))) == [True, False]
    assert spark.createDataFrame([({"b": "x" * 9, "a": "1"},)], "m map<string,string>").select(text.bounded_map(F.col("m"), 1, 5)).first()[0] == {"a": "1"}


def test_distances_agree(spark):
    a = [F.lit(x) for x in (37.0, 127.0, 37.01, 127.02)]
    x, y = spark.range(1).select(geo.haversine(*a), geo.great_circle(*a)).first()
    assert abs(x - y) < 0.01 and 2000 < x < 2200


def test_asof_and_densify(spark):
    p = spark.createDataFrame([(1, "202401", 10), (1, "202403", 30), (2, "202404", 5)], "k int, month string, price int")
    got = {r["k"]: r for r in prices.asof(p, ["k"], {"t": "202402"}, ["price"]).collect()}
    assert got[1]["t"]["price"] == 10 and 2 not in got
    assert {r["k"]: r["t"]["price"] for r in prices.asof(p, ["k"], {"t": "202402"}, ["price"], forward=True).collect()} == {1: 30, 2: 5}
    dense = prices.densify(p, ["k"], "202402", "202404", "price").orderBy("k", "month").collect()
    assert [r["price"] for r in dense] == [10, 30, 30, None, None, 5]
    assert prices.interpolate(p, ["k"], "202402", "price").orderBy("k").first()["price"] == 20
    asked = spark.createDataFrame([(1, "202402", "a"), (1, "202312", "b"), (3, "202402", "c")], "k int, at string, n string")
    assert {r["n"]: r["found"] and r["found"]["price"] for r in prices.asof_many(asked, p, ["k"], "at", ["price"]).collect()} == {"a": 10, "b": None, "c": None}


def test_formulas(spark):
    cases = {"few": [1.0, 2.0, 9.0], "ten": [0.0, *map(float, range(2, 10)), 100.0], "four": [1.0, 2.0, 3.0, 10.0]}
    rows = [(k, x) for k, xs in cases.items() for x in xs]
    got = {r["k"]: r["mean"] for r in trimmed_means(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert got == {"few": 4.0, "ten": 5.5, "four": 4.0}
    pairs = spark.createDataFrame([("a", 0, 0.1, 100), ("a", 1, 0.1, 200), ("a", 4, 2.0, 900)], "q string, lag int, off double, pyeong int")
    got = {r["formula"]: r["predicted"] for r in predictions(pairs, ["q"]).collect()}
    assert len(FORMULAS) == 18 and got["same_month_average"] == 100 and got["trailing_3m_median"] == 150 and abs(got["trailing_3m_weighted"] - 400 / 3) < 1e-9
    assert got["wide_area_6m_median"] == 200 and got["trailing_6m_average"] == 150 and got["trailing_12m_trimmed"] == 150


def test_components_and_pairs(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (200, 150)]
    got = {r["node"]: r["root"] for r in entity.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 150, 150: 150}
    assert entity.components(spark.createDataFrame([], "a long, b long")).collect() == []
    pts = spark.createDataFrame([(1, 37.0, 127.0, "d"), (2, 37.0002, 127.0002, "d"), (3, 37.0, 127.0, "e"), (4, 37.01, 127.0, "d")], "complex_id int, lat double, lng double, k string")
    assert [tuple(r) for r in entity.near_pairs(pts, ["k"], 35).collect()] == [(1, 2)]


def test_upsert_adds_columns(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k int, v string, w int")
    assert sorted(tuple(r) for r in entity.upsert(old, new, ["k"]).collect()) == [(1, "a", None), (2, "c", 1), (3, "d", 2)]
    assert sorted(tuple(r) for r in entity.insert_new(old, new, ["k"]).collect()) == [(1, "a", None), (2, "b", None), (3, "d", 2)]


def test_page_and_tiles(spark):
    df = spark.range(25).withColumnRenamed("id", "growth_rate")
    assert [(r["growth_rate"], r["rank"]) for r in ranks.page(df, [F.col("growth_rate").desc()], 3, 10).collect()] == [(4, 21), (3, 22), (2, 23), (1, 24), (0, 25)]
    assert tiles(spark, 0.0, 0.0, 3, 3, 1.0).first()[:2] == (1, 1)


@pytest.mark.parametrize("metric", ["plan"])
def test_filters_reach_the_scan(spark, metric):
    from ridgeline.sources import bindings as b

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = b.deals(spark, "/root/testdata/sf0.001").where("complex_id = 7").select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(l_suppkey,7)" in plan and "l_tax" not in plan


def test_percent_rounds_as_sql_does(spark):
    import duckdb

    rates = [0.0715, -0.6395, -0.6385, 0.0005, -0.0005, 0.1, 0.0, None, *(i / 10_000 for i in range(-9995, 10_000, 10))]
    want = [duckdb.execute("select round(?::double * 100, 1)", [r]).fetchall()[0][0] if r is not None else None for r in rates]
    assert column(spark, rates, "double", numbers.percent(F.col("x"))) == want
    assert column(spark, [1e300, -1e308], "double", numbers.rounded("x", 9)) == [1e300, -1e308]


def test_half_of_a_mean_of_means_goes_up_in_any_order(spark):
    from itertools import permutations

    from ridgeline.plans.growth import mean_over_period

    rows = []
    for k, order in enumerate(permutations((107_470, 141_421, 273_928))):  # 2640.5 exactly, below it as a sum of doubles
        for t, total in enumerate(order):
            rows += [(k, t, f"{1990 + i // 12}{i % 12 + 1:02d}", total // 66 + (i < total % 66)) for i in range(66)]
    found = mean_over_period(spark.createDataFrame(rows, "complex_id int, type_id int, month string, pyeong int"), "199001", "199912")
    assert {tuple(r) for r in found.collect()} == {(k, 2641, 66) for k in range(6)}


def test_pairs_are_shuffled_by_their_keys_alone(spark):
    import re

    pairs = spark.createDataFrame([("q", 0, 1.0, 5), ("q", 2, 2.0, 7)], "q string, lag int, off double, pyeong int")
    plan = predictions(pairs, ["q"])._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert found and all(re.fullmatch(r"q#\d+, \d+", x) for x in found), found


def test_the_report_stores_one_row_a_quote(spark, monkeypatch):
    from ridgeline.plans import matching as m

    kept, store = {}, m.entity.shared_table
    monkeypatch.setattr(m.entity, "shared_table", lambda df, name: kept.setdefault(name, store(df, name)))
    rows, _ = m.tested(spark, "/root/testdata/sf0.001")
    assert kept["predictions"].count() == kept["split"].count() == rows.select(*m.QUOTE).distinct().count() < rows.count()

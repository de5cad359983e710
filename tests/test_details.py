"""Cases by hand: Korean order, registry matches, the last of repeated keys, labels, recent prices."""

import datetime as dt

from pyspark.sql import functions as F

from ridgeline.operators import entity, ranks
from ridgeline.plans import details as d


def test_korean_order_of_mixed_names(spark):
    """Hangul stands before Latin, case and width don't part equal letters, digits stand before both."""
    names = ["하늘", "apple", "가람", "Banana", "나무", "2단지", "10단지", "가", "강남", "갑", "éclair"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.collate("n", "ko")).collect()]
    assert got == ["10단지", "2단지", "가", "가람", "갑", "강남", "나무", "하늘", "apple", "Banana", "éclair"]


def test_ranks_in_groups_over_several_ranges(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("v"), "id").repartition(6).withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    got = {r["id"]: r["rank"] for r in ranks.group_rank(rows, ["g"], [F.col("v").desc(), F.col("id").asc()], "rank").collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r["v"], r["id"])):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        want[r["id"]] = seen[r["g"]]
    assert got == want


def test_registry_prefers_the_district_and_falls_back_to_the_province(spark):
    reg = spark.createDataFrame(
        [("p1", 100, "11110", "11", "서울종로구사직동12", ["사직파크", "", ""]), ("p2", 300, "11110", "11", "서울종로구사직동12", ["사직파크", "", ""]), ("p3", 900, "11200", "11", "서울성동구사직동12", ["사직파크", "", ""]), ("p4", 5, "11200", "11", "서울성동구금호동7", ["다른이름", "금호자이", ""]), ("p5", 5, "11200", "11", "서울성동구금호동77", ["금호자이", "", ""]), ("p6", None, "11200", "11", "서울성동구금호동7", ["금호자이", "", ""])],
        "pk string, units int, lawd string, sido string, address string, names array<string>",
    )
    want = spark.createDataFrame([(1, "11110", "11", "사직동12", "사직파크"), (2, "11999", "11", "금호동7", "금호자이"), (3, "11110", "11", "사직동12", "전혀다른곳"), (4, "26110", "26", "사직동12", "사직파크"), (5, "11110", "11", "", "사직파크")], "complex_id int, lawd string, sido string, address_key string, key string")
    got = {r["complex_id"]: (r["pk"], r["source"], r["score"]) for r in d.registry_match(want, reg).collect()}
    assert got == {1: ("p2", "lawd_address_name", 100), 2: ("p4", "sido_address_name", 100)}


def test_the_last_of_repeated_keys_wins(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 3), (1, "z", 1), (3, None, 5)], "k int, v string, n int").repartition(3)
    got = sorted(tuple(r) for r in entity.upsert(old, new, ["k"], order=[F.col("n")]).collect())
    assert got == [(1, "y", 3), (2, "b", 0), (3, None, 5)]
    assert sorted(tuple(r) for r in entity.upsert(old, new, ["k"]).collect()) == [(1, "z", 1), (2, "b", 0), (3, None, 5)]
    keyless = spark.createDataFrame([(None, "p", 1), (None, "q", 2)], "k int, v string, n int")
    assert sorted(str(tuple(r)) for r in entity.upsert(old.where("false"), keyless, ["k"], order=[F.col("n")]).collect()) == ["(None, 'q', 2)"]


def test_labels_of_visits(spark):
    t = dt.datetime(2026, 1, 1)
    shape = "visitor_id int, ts timestamp, event_name string, path string, agent string, country string, city string, language string"
    rows = [(1, t, "view", "/a", d.AGENTS[0], "KR", "", "ko"), (2, t, "view", "/b", d.AGENTS[1], "", "", None), (2, t + dt.timedelta(1), "click", "/b", None, None, "Busan", ""), (3, t, "view", "/a", d.AGENTS[0], "KR", "Seoul", "ko")]
    got = {}
    for r in d.top_labels(spark.createDataFrame(rows, shape), 2).collect():
        got.setdefault(r["kind"], {})[r["label"]] = (r["visitors"], r["events"])
    assert got["page"] == {"/a": (2, 2), "/b": (1, 1)} and got["event"] == {"view": (3, 3), "click": (1, 1)}
    assert got["language"] == {"ko": (2, 2), d.UNKNOWN: (1, 2)} and got["browser"] == {"Safari": (2, 2), "Unknown": (1, 1)}  # Unknown was seen later than Edge
    assert len(got["location"]) == 2 and got["device"] == {"mobile": (2, 2), "desktop": (1, 2)}


def test_recent_price_stands_for_the_current_month(spark):
    series = spark.createDataFrame([(1, 1, "202401", 5), (1, 1, "202402", 5), (1, 2, "202402", 7), (1, 3, "202402", None)], "complex_id int, type_id int, month string, price int")
    recent = spark.createDataFrame([(1, 1, 9), (1, 3, 4)], "complex_id int, type_id int, price int")
    got = {(r["type_id"], r["month"]): r["price"] for r in d.recent_over_month(series, recent, "202402").collect()}
    assert got == {(1, "202401"): 5, (1, "202402"): 9, (2, "202402"): 7, (3, "202402"): 4}

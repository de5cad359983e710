"""All snapshots in one job against single builds, its order, and what must fail."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import bands, snapshots
from ridgeline.plans.growth import END, TODAY
from ridgeline.plans.serving import all_snapshots
from ridgeline.sources import bindings as b

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def types(spark):
    deals = b.deals(spark, SF).withColumn("m2", F.col("type_id") * 40 - 15)
    return bands.summaries(deals, END, TODAY)


@pytest.fixture(scope="module")
def complexes(spark):
    return b.complexes(spark, SF).select("complex_id", "name", "households", "sido_key", "sigungu_key")


def test_one_read_of_the_deals(types, complexes):
    items = bands.rankings(types, complexes)
    # rankings() sorts into a written table, so the plan that reads the deals is that of the items before.
    plan = types._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and "lineitem" not in items._jdf.queryExecution().executedPlan().toString()


def test_counts_equal_single_builds(spark, types, complexes, tmp_path):
    root = str(tmp_path)
    all_snapshots(spark, SF, root)
    headers = {(h["start_month"], h["area_band"], h["basis"], h["min_households"]): h for h in snapshots.headers(spark, root).collect()}
    assert len(headers) == 160
    for start, area, basis, least in [("199706", "all", "end", 0), ("199706", "30", "start", 100), ("200003", "40", "start", 0), ("199506", "20", "end", 0)]:
        one = bands.rankings(types.where(F.col("start_month") == start), complexes, [basis], [least], [area])
        header = headers[(start, area, basis, least)]
        assert header["item_count"] == one.count() and header["band_count"] == one.select("band_key").distinct().count()
        assert header["status"] == ("active" if header["item_count"] else "skipped")
        if header["item_count"]:
            got = bands.read(spark, header, "items").select("complex_id", "rank", "band_key").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, one.select("complex_id", "rank", "band_key").collect()))
    assert {h["status"] for h in headers.values()} == {"active", "skipped"}


def test_headers_change_at_once_and_bad_bands_change_nothing(spark, types, complexes, tmp_path, monkeypatch):
    root, starts = str(tmp_path), ["199706"]
    items = bands.rankings(types.where("start_month = '199706'"), complexes)
    first = bands.save_all(spark, root, items, END, starts=starts)
    assert {h["path"] for h in snapshots.headers(spark, root).where("status = 'active'").collect()} == {first}
    made = bands.bands_of
    monkeypatch.setattr(bands, "bands_of", lambda rows: made(rows.where("rank > 1")))
    with pytest.raises(snapshots.SnapshotError):
        bands.save_all(spark, root, items, END, starts=starts)
    assert {h["path"] for h in snapshots.headers(spark, root).where("status = 'active'").collect()} == {first}
    monkeypatch.undo()
    second = bands.save_all(spark, root, items, END, starts=starts)
    states = {(h["path"], h["status"]) for h in snapshots.headers(spark, root).collect()}
    assert {(second, "active"), (first, "superseded")} <= states and (first, "active") not in states


def test_full_order_with_ties_and_hidden_duplicates(spark):
    shape = "complex_id long, type_id int, m2 int, period int, start_month string, start_price int, start_pyeong int, end_price int, end_pyeong int"
    row = lambda c, e=200, p=20, t=1, m2=100: (c, t, m2, 12, "199906", 100, 10, e, p)
    types = spark.createDataFrame([row(1), row(2), row(3, p=21), row(4, 300), row(5), row(6), row(6, 200, 20, 2, 90), row(7)], shape)
    named = spark.createDataFrame([(1, "다", 50), (2, "가", 50), (3, "하", 50), (4, "하", 50), (5, "가", 50), (6, "나", None), (7, "b", 500)], "complex_id long, name string, households int")
    found = bands.rankings(types, named, ["end"], [0], ["all"])
    assert [r["complex_id"] for r in found.orderBy("rank").collect()] == [4, 3, 2, 5, 6, 1, 7]  # Hangul before Latin in Korean order
    assert found.where("complex_id = 6").first()["type_id"] == 2  # the smaller of equal types
    gone = spark.createDataFrame([(2, 0), (3, 100)], "complex_id long, min_households int")
    kept = bands.rankings(types, named, ["end"], [0, 100], ["all"], gone)
    assert sorted((r["min_households"], r["complex_id"]) for r in kept.collect()) == [(0, 1), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (100, 7)]


def test_freshness_and_recent_prices(spark):
    shape = "complex_id long, type_id int, m2 int, month string, deal_date date, amount int, pyeong int"
    import datetime as dt

    deal = lambda c, day, amount: (c, 1, 100, day[:4] + day[5:7], dt.date.fromisoformat(day), amount, amount // 10)
    rows = [deal(1, "1999-05-10", 100), deal(1, "2000-05-20", 400), deal(1, "2000-06-01", 600), deal(2, "1999-02-01", 100), deal(2, "2000-06-01", 200), deal(3, "1999-06-01", 100), deal(3, "2000-03-15", 300), deal(4, "1999-06-01", 100), deal(4, "2000-02-15", 300)]
    got = {(r["complex_id"], r["period"]): (r["start_price"], r["end_price"]) for r in bands.summaries(spark.createDataFrame(rows, shape), "200006", "2000-06-15", [12]).collect()}
    # 1: the last 30 days count together; 2: its start is four months old; 3: its end three months; 4: its end is too old.
    assert got == {(1, 12): (100, 500), (3, 12): (100, 300)}

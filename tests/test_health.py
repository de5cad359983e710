"""The registry: all seven checks, one broken on purpose, states made by hand."""

import dataclasses
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import bands, snapshots
from ridgeline.plans import health


@pytest.fixture(scope="module")
def context(spark):
    now = dt.datetime(2000, 6, 15, 12)
    fetches = spark.createDataFrame([("a", "200006", "completed", 5), ("b", "200006", "completed", 2), ("a", "200005", "completed", 5), ("b", "200005", "failed", 0)], "code string, month string, status string, saved long")
    deals = spark.createDataFrame([("200006", False), ("200006", True), ("200005", True), ("200005", True), ("200005", False)], "month string, cancelled boolean")
    complexes = spark.createDataFrame([(1, 37.5, 127.0, 10), (2, 37.5, 127.0, None), (3, None, None, 5)], "complex_id long, lat double, lng double, households int")
    items = spark.createDataFrame([(3, level, 0, "200006", now) for level in health.MAP_LEVELS] + [(6, level, 0, "200006", now - dt.timedelta(hours=40)) for level in health.MAP_LEVELS] + [(12, "sido", 0, "200006", now)], "period int, level string, min_households int, end_month string, updated_at timestamp")
    head = lambda a, s, n, basis="start", at=now: ("trades", basis, "200003", "200006", a, 0, "p", s, n, n, at)
    headers = spark.createDataFrame([head("all", "active", 3), head("10", "active", 0), head("20", "active", 3, at=now - dt.timedelta(hours=37)), head("30", "building", 3), head("all", "superseded", 3, "end")], snapshots.HEADER)
    reads = {"filled": lambda: spark.range(3), "empty": lambda: spark.range(0)}
    return health.Context(spark, fetches, deals, complexes, items, headers, ["200006", "200005"], 2, "200006", str(now), (3, 6, 12), (0,), reads)


def rows(df):
    return {json.dumps([v for v in r["metrics"].asDict().values()][:4], default=str): r["status"] for r in df.collect()}


def test_all_seven_and_a_broken_one(context):
    health.CHECKS["broken"] = ("system", "Raises", health.broken)
    try:
        found = {r["key"]: r for r in health.report(context).collect()}
    finally:
        del health.CHECKS["broken"]
    assert list(found) == [*health.CHECKS, "broken"] and len(health.CHECKS) == 7
    got = {k: (r["status"], r["passed"], r["warned"], r["failed"]) for k, r in found.items()}
    assert got["recent_fetches"] == ("fail", 1, 0, 1) and got["recent_deals"] == ("warn", 1, 1, 0) and got["complex_coverage"] == ("warn", 0, 1, 0)
    assert got["map_matrix"] == ("fail", 1, 1, 1) and got["read_times"] == ("fail", 1, 0, 1) and got["long_jobs"][0] == "pass"
    assert got["broken"][0] == "fail" and "broken on purpose" in found["broken"]["message"] and found["broken"]["category"] == "system"
    assert json.loads(found["map_matrix"]["metrics"])[0]["reason"] == "missing_level:apartment+dong+sigungu"
    one = health.summary(health.report(context, ["long_jobs", "recent_deals"])).first()
    assert tuple(one) == ("warn", 1, 1, 0, 2)


def test_band_matrix(context):
    found = {(r["metrics"]["basis"], r["metrics"]["area_band"]): (r["status"], r["metrics"]["reason"]) for r in health.band_matrix(dataclasses.replace(context, periods=(3,))).collect()}
    assert found[("start", "all")] == ("pass", "") and found[("start", "10")] == ("warn", "area_empty") and found[("start", "20")] == ("warn", "stale_cache")
    assert found[("start", "30")] == ("warn", "area_empty") and found[("end", "all")] == ("fail", "core_empty_or_bands_missing") and len(found) == 2 * len(bands.AREA_BANDS)


def test_empty_tables(context):
    none = {k: getattr(context, k).where("false") for k in ("fetches", "deals", "complexes", "map_items", "headers")}
    found = {r["key"]: r["status"] for r in health.report(dataclasses.replace(context, **none, reads={})).collect()}
    assert [found[k] for k in ("recent_fetches", "recent_deals", "complex_coverage", "map_matrix", "band_matrix")] == ["fail"] * 5


def test_checks_run_beside_each_other(context):
    slow = F.udf(lambda x: __import__("time").sleep(3) or "pass", "string")
    for i in range(4):
        health.CHECKS[f"slow{i}"] = ("t", "t", lambda c: c.spark.range(1).select(slow("id").alias("status"), F.struct("id").alias("metrics")))
    try:
        took = [r["took_ms"] for r in health.report(context, [f"slow{i}" for i in range(4)]).collect()]
    finally:
        for i in range(4):
            del health.CHECKS[f"slow{i}"]
    assert min(took) >= 3000

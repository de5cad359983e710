"""Bounds of metadata and user information as unit cases."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import metadata as m


def kept(spark, value):
    text = value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)
    return json.loads(spark.createDataFrame([(text,)], "x string").select(m.metadata(F.col("x"))).first()[0])


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, {}),
        ("", {}),
        ("no json", {}),
        ([1, 2], {}),
        ("3", {}),
        ({}, {}),
        ({"a": None, "b": True, "c": 1, "d": 2.5, "e": "x", "f": [], "g": {}}, {"a": None, "b": True, "c": 1, "d": 2.5, "e": "x", "f": [], "g": {}}),
        ({"text": "é" * 600}, {"text": "é" * 500}),
        ({'q"uote\\': 'li"ne\n\t'}, {'q"uote\\': 'li"ne\n\t'}),
        ({"k" * 100: 1}, {"k" * 80: 1}),
        ({"list": list(range(50))}, {"list": list(range(20))}),
        ({"inner": {f"k{i:02}": i for i in range(20)}}, {"inner": {f"k{i:02}": i for i in range(12)}}),
        ({f"k{i:02}": i for i in range(40)}, {f"k{i:02}": i for i in range(30)}),
        ({"a": [{"b": {"c": [1, "x" * 501]}}]}, {"a": [{"b": {"c": [1, "x" * 500]}}]}),
        ({f"k{i}": "x" * 500 for i in range(9)}, {"truncated": True}),
    ],
)
def test_metadata(spark, given, want):
    assert kept(spark, given) == want


def test_what_lies_too_deep_is_text(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": [1] * 200}}}}}}
    found = kept(spark, deep)["a"]["b"]["c"]["d"]["e"]
    assert isinstance(found, str) and len(found) == m.DEEP_CHARS and found.startswith('{"f":[1,')


def test_user_info(spark):
    agent = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile Safari/604.1"
    given = {"countryCode": " KR ", "geoCity": "c" * 200, "acceptLanguage": "ko-KR,en", "languages": ["ko", "", "en", "a", "b", "c", "d"], "viewportWidth": "390.5", "viewportHeight": -5, "screenWidth": 99999, "screenHeight": "tall", "devicePixelRatio": 2.625, "touchSupported": "yes", "utmCampaign": "u" * 300, "browser": "", "platform": None, "other": 1}
    rows = spark.createDataFrame([(json.dumps(given), agent), ("[1]", None), (None, agent)], "i string, a string")
    found = [json.loads(r[0]) for r in rows.select(m.user_info(F.col("i"), F.col("a"))).collect()]
    assert found[0] == {"country": "KR", "city": "c" * 120, "language": "ko-KR", "languages": ["ko", "en", "a", "b", "c"], "browser": "Safari", "browserVersion": "17.2", "os": "iOS", "osVersion": "17.2", "deviceType": "mobile", "viewportWidth": 391, "viewportHeight": 0, "screenWidth": 10000, "devicePixelRatio": 2.63, "utmCampaign": "u" * 160}
    assert found[1] == {"browser": "Unknown", "os": "Unknown", "deviceType": "desktop"}
    assert found[2]["os"] == "iOS" and "country" not in found[2]


def test_numbers(spark):
    cases = [("3", 3.0), ('"4.5"', 4.5), ('" "', 0.0), ("true", 1.0), ("false", 0.0), ("null", 0.0), ('"x"', None), ("[1]", None), (None, None), ('"Infinity"', None)]
    rows = spark.createDataFrame(cases, "x string, want double").select(m.number(F.try_parse_json("x")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_json_is_parsed_once_and_the_bounds_grow_with_the_depth(spark):
    plan = lambda c: spark.createDataFrame([("{}",)], "x string").select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(m.metadata(F.col("x"))).count("parse_json(") == 1
    sizes = [len(plan(m.bounded(F.try_parse_json("x"), depth))) for depth in (1, 2, 3)]
    assert sizes[2] - sizes[1] < 1.5 * (sizes[1] - sizes[0])

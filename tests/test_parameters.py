"""Clamps and normalisers, and the merge of a region over three tables."""

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import numbers, parameters as p
from ridgeline.operators import bands, entity


@pytest.mark.parametrize(("kind", "value", "want"), [("page_size", 5, 10), ("page_size", "70", 70), ("page_size", 1000, 100), ("page_size", None, 50), ("rows", 0, 50), ("rows", -3, 1), ("rows", "x", 50), ("runs", 99, 50), ("markers", 1, 10), ("hits", 21.9, 20), ("days", float("nan"), 7), ("days", True, 7), ("days", 400, 90)])
def test_clamps(kind, value, want):
    assert p.clamp(kind, value) == want


def test_normalisers():
    assert p.periods([5, "0.25", 1, 1.0, 0.5, -1, "x", None, 0.01]) == [(1, 0), (3, 0), (6, 0), (12, 1), (60, 5)]
    assert p.periods(1.5) == [(18, 2)] and p.periods([]) == []
    assert p.period_months([60, "3", 3.0, 2.5, 0, None]) == [3, 60]
    assert p.households(["100", 0, -5, 99.9, "x"]) == [0, 99, 100] and p.households(7) == [7]
    assert p.bases(["end", "start", "other", "end"]) == ["start", "end"] and p.bases("end") == ["end"] and p.bases([None]) == ["start"]
    assert p.areas(["30", 10, "x"], bands.AREA_BANDS) == ["all", "10", "30"]
    assert p.region("11110:사직동") == {"sido": "11", "sigungu": "11110", "dong": "11110:사직동"}
    assert p.region("", "411", "4") == {"sido": "", "sigungu": "", "dong": ""} and p.region(sigungu="41135")["sido"] == "41"


def test_price_of_a_quote(spark):
    rows = spark.createDataFrame([(50000.0, 33.0, 25.0), (50000.0, None, 25.0), (50000.0, 0.0, 25.0), (0.0, 33.0, 25.0), (50000.0, None, None)], "mid double, supply double, exclusive double")
    got = [r[0] for r in rows.select(numbers.quote_pyeong(F.col("mid"), F.col("supply"), F.col("exclusive"))).collect()]
    assert got == [1515, 2000, 2000, None, None]


def test_a_region_is_merged_with_all_that_hangs_on_it(spark):
    apartments = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "apt_id int, region string")
    types = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4), (14, 99)], "type_id int, apt_id int")
    prices = spark.createDataFrame([(10, "202401"), (10, "202402"), (12, "202401"), (13, "202401"), (77, "202401")], "type_id int, month string")
    new = (spark.createDataFrame([(1, "a"), (5, "a")], "apt_id int, region string"), spark.createDataFrame([(20, 5)], "type_id int, apt_id int"), spark.createDataFrame([(20, "202403")], "type_id int, month string"))
    got = entity.merge_region((apartments, types, prices), new, F.col("region") == "a", ("apt_id", "type_id"))
    rows = [sorted(map(str, map(tuple, t.collect()))) for t in got]
    assert rows == [["(1, 'a')", "(3, 'b')", "(4, None)", "(5, 'a')"], ["(12, 3)", "(13, 4)", "(14, 99)", "(20, 5)"], ["(12, '202401')", "(13, '202401')", "(20, '202403')", "(77, '202401')"]]

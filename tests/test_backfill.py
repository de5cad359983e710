"""The back-fill: killed and run again, quotas, failures, filters."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import backfill

MONTHS = ["202401", "202402", "202403"]
ITEMS = "array<map<string, string>>"


@pytest.fixture()
def tasks(spark):
    return backfill.plan(spark.createDataFrame([(str(i),) for i in range(4)], "code string"), MONTHS)


def provider(fails=(), quota=(), die_at=None, seen=None):
    def fetch(claimed):
        names = [tuple(r) for r in claimed.select("code", "month").collect()]
        if seen is not None:
            seen.extend(names)
        if die_at in names:
            raise KeyboardInterrupt
        key = F.concat_ws("-", "code", "month")
        items = F.transform(F.sequence(F.lit(0), F.col("code").cast("int")), lambda i: F.create_map(F.lit("id"), F.concat_ws("-", key, i.cast("string"))))
        error = F.when(key.isin(*quota), "LIMITED: Quota exceeded").when(key.isin(*fails), "timeout") if fails or quota else F.lit(None).cast("string")
        return claimed.select("code", "month", F.size(items).cast("long").alias("total_count"), error.alias("error"), items.alias("items"))

    return fetch


def ids(spark, root):
    return sorted(r[0] for r in backfill.stored(spark, root).select(F.col("item")["id"]).collect())


def test_a_killed_run_goes_on_and_nothing_is_there_twice(spark, tasks, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    assert backfill.run(spark, one, tasks, provider(), 100, wave=5) == backfill.Outcome(12, 0, "")
    first, second = [], []
    with pytest.raises(KeyboardInterrupt):
        backfill.run(spark, two, tasks, provider(die_at=("2", "202402"), seen=first), 100, wave=5)
    assert len(ids(spark, two)) == 11  # what the first wave brought
    states = {(r["code"], r["month"]): r["status"] for r in backfill.ledger(spark, two).collect()}
    assert sorted(states.values()) == ["completed"] * 5 + ["started"] * 5
    assert backfill.run(spark, two, tasks, provider(seen=second), 100, wave=5) == backfill.Outcome(7, 0, "")
    assert ids(spark, two) == ids(spark, one) and len(ids(spark, one)) == 30
    done = {k for k, s in states.items() if s == "completed"}
    assert not done & set(second) and len(second) == 7
    assert backfill.run(spark, two, tasks, provider(seen=second), 100).completed == 0 and len(second) == 7


def test_limit_and_quota(spark, tasks, tmp_path):
    root = f"{tmp_path}/q"
    assert backfill.run(spark, root, tasks, provider(), 3, wave=2) == backfill.Outcome(3, 0, "limit")
    assert backfill.run(spark, root, tasks, provider(quota=("1-202402",), fails=("0-202402",)), 100, wave=4) == backfill.Outcome(2, 2, "quota")
    shown = {r["status"]: r["tasks"] for r in backfill.progress(spark, root, tasks).collect()}
    assert shown == {"completed": 5, "failed": 2, "pending": 5}
    assert backfill.run(spark, root, tasks, provider(), 100) == backfill.Outcome(7, 0, "")
    assert len(ids(spark, root)) == 30
    errors = {r["error"] for r in backfill.ledger(spark, root).collect()}
    assert errors == {None}


def test_what_is_filtered_is_counted_and_missing_answers_fail(spark, tasks, tmp_path):
    root = f"{tmp_path}/f"
    got = backfill.run(spark, root, tasks, lambda c: provider()(c).where("month <> '202403'"), 100, keep=lambda items: items.where("not endswith(item['id'], '-0')"))
    assert got == backfill.Outcome(8, 4, "")
    rows = {(r["code"], r["month"]): (r["fetched"], r["saved"], r["filtered"], r["error"]) for r in backfill.ledger(spark, root).collect()}
    assert rows[("0", "202401")] == (1, 0, 1, None) and rows[("3", "202402")] == (4, 3, 1, None) and rows[("1", "202403")][-1] == "no answer"
    assert backfill.run(spark, root, tasks, provider(), 100, force=True).completed == 12
    assert len(ids(spark, root)) == 30

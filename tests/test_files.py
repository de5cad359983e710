"""Recorded pages and sitemaps through the data source interface."""

import os

import pytest
from pyspark.sql import functions as F

from ridgeline.sources import files, trades

PAGE = "<response><header><resultCode>00</resultCode></header><body><items>{}</items><totalCount>{}</totalCount></body></response>"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    files.register(spark)


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_recorded_pages_are_read_in_parts_and_parsed(spark, tmp_path):
    for code in ("11", "26"):
        for month in ("202401", "202402"):
            for page in range(1, 6):
                at = tmp_path / code / month
                at.mkdir(parents=True, exist_ok=True)
                items = "".join(f"<item><aptNm>{code}-{month}-{page}-{i} é</aptNm><dealAmount>1,{page}00</dealAmount></item>" for i in range(page))
                (at / f"{page}.xml").write_text(PAGE.format(items, 15))
    (tmp_path / "notes.txt").write_text("no page")
    df = spark.read.format("recorded_pages").option("perpartition", 3).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 7 and df.count() == 20
    deals = trades.normalise(trades.parse_trades(df.withColumnsRenamed({"code": "lawd", "month": "deal_month"})))
    assert deals.count() == 4 * 15 and deals.where("amount = 1500").count() == 4 * 5
    assert deals.where("name = '26-202402-2-1 é'").count() == 1
    assert spark.read.format("recorded_pages").option("code", "26").load(f"file://{tmp_path}").count() == 10
    assert spark.read.format("recorded_pages").load(f"{tmp_path}/none").count() == 0


def sitemap(df, path, **options):
    df.write.format("sitemap").options(base="https://example.org", **options).mode("append").save(str(path))


def test_files_are_cut_at_their_size_and_escaped(spark, tmp_path, monkeypatch):
    df = spark.range(0, 130_000, 1, 2).select(F.concat(F.lit("/a?x="), "id", F.lit("&y=<ü>")).alias("path"), F.when(F.col("id") % 2 == 0, F.lit("2026-01-01")).alias("lastmod"), F.lit(None).cast("string").alias("priority"))
    sitemap(df.unionByName(df.limit(1).withColumn("path", F.lit(None).cast("string"))), tmp_path / "s")
    found = files.sitemap_files(spark, str(tmp_path / "s"))
    assert len(found) == 4 and len(names(tmp_path / "s")) == 5
    counts = sorted(open(f).read().count("<url>") for f in found)
    assert counts == [15_000, 15_000, 50_000, 50_000]
    back = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(found)
    assert back.count() == 130_000 and back.where("loc = 'https://example.org/a?x=77&y=<ü>' and lastmod is null").count() == 1


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    sitemap(spark.range(10).select(F.concat(F.lit("/"), "id").alias("path")), tmp_path / "s")
    before = names(tmp_path / "s")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.concat(F.lit("/new"), "id")).alias("path"))
    with pytest.raises(Exception, match="no"):
        sitemap(bad, tmp_path / "s")
    assert names(tmp_path / "s") == before
    sitemap(spark.range(3).select(F.concat(F.lit("/n"), "id").alias("path")), tmp_path / "s")
    after = names(tmp_path / "s")
    assert not set(before) & set(after) - {"sitemap.xml"} and "sitemap.xml" in after
    assert sum(open(f).read().count("<url>") for f in files.sitemap_files(spark, str(tmp_path / "s"))) == 3


def test_nothing_to_write(spark, tmp_path):
    sitemap(spark.range(0).select(F.lit("/").alias("path")), tmp_path / "s")
    assert files.sitemap_files(spark, str(tmp_path / "s")) == [] and names(tmp_path / "s") == ["sitemap.xml"]
    with pytest.raises(Exception, match="path"):
        sitemap(spark.range(1), tmp_path / "t")

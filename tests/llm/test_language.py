"""Rejection by the language model: unlearned languages and junk go, clean documents stay."""

from pyspark.sql import functions as F

from ridgeline.llm.common import documents
from ridgeline.llm.language import keep_known, learn, predict

SF = "/root/testdata/sf0.01"
OTHER = ["Ala ma kota i idzie dzisiaj do szkoły, bo pogoda jest ładna i ciepła", "Это совсем другой язык, который никто здесь не учил", "Minä olen suomalainen ja puhun suomea joka päivä kotona", "漢字仮名交じり文は日本語です。今日は天気がいいですね"]
JUNK = ["zxqj kvvw qqpt xkcd wrtz pqrs vvvk", "3f9a 8b2c deadbeef 0xff a1b2c3 f00d cafebabe", "QWxhZGRpbjpvcGVuIHNlc2FtZQ== dGhpcyBpcyBqdW5r", "!!!! ???? 12 34"]


def test_unlearned_languages_and_junk_go_and_clean_documents_stay(spark):
    docs = documents(spark, SF)
    model = learn(docs)
    texts = [(i, t) for i, t in enumerate(OTHER + JUNK)]
    found = predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    assert all(r["rejected"] for r in found), [(texts[r["doc_id"]][1], r["score"]) for r in found if not r["rejected"]]
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    kept, whole = keep_known(docs, model).count(), lettered.count()
    assert whole - kept <= 0.002 * whole + 1
    held = predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0 and lang is not null and lang_pred <> 'und'")
    assert held.where("lang = lang_pred").count() >= 0.99 * held.count() > 100


def test_repeated_rows_odd_names_and_empty_tables(spark, odd, empty):
    model = learn(documents(spark, SF))
    assert keep_known(empty, model).collect() == [] and predict(empty, model).collect() == []
    assert keep_known(odd, model).columns == odd.columns
    assert predict(odd, model).count() == odd.count()
    none = learn(empty)
    assert none is None and keep_known(odd, none).count() == 0
    clashing = documents(spark, SF).withColumns({"score": F.lit(1), "rejected": F.lit("x"), "found": F.lit(2)})
    assert learn(clashing) is not None and set(keep_known(clashing, model).columns) == set(clashing.columns)


def test_a_very_long_text(spark):
    model = learn(documents(spark, SF))
    whole = documents(spark, SF).where("lang = 'en'").orderBy("doc_id").limit(60).agg(F.repeat(F.concat_ws(" ", F.collect_list("text")), F.lit(20)).alias("text")).withColumn("doc_id", F.lit(1))
    row = predict(whole, model).first()
    assert row["lang_pred"] == "en" and not row["rejected"]

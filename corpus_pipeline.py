"""The corpus pipeline: language filter, line dedup, near dedup, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, with n_chars that of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, documents, marked, written
from ridgeline.llm.language import keep_known, learn
from ridgeline.llm.line_dedup import dedup_lines
from ridgeline.llm.near_copies import drop_near_copies
from ridgeline.llm.packing import pack
from ridgeline.llm.pii import mask
from ridgeline.llm.queries import tokenizer_file


#: Whole texts that an executor's Python workers and their Arrow buffers hold at once; Spark's own bounds are 10,000 rows and 64 MB.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def _small_batches(spark: SparkSession) -> None:
    """Holds from now on, since a stage's result is computed when it is written."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def _counted(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars counted anew if it is there."""
    return df.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, without a letter, or that the language model rejects."""
    _small_batches(spark)
    return keep_known(docs, learn(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines like earlier ones; every document stays, if need be with an empty text."""
    return _counted(dedup_lines(docs, counts=False), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash and a Jaccard similarity of 0.8 or more of five-word shingles link; documents left empty form one group."""
    _small_batches(spark)
    return drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the kind of personal data in its place; every document stays."""
    _small_batches(spark)
    return _counted(mask(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    _small_batches(spark)
    return pack(docs, tokenizer_file())


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: SQL can express neither the language model nor the random field; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    since, before = marked(), {key: spark.conf.get(key) for key in BATCHES}
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            discard(spark, since, [docs])  # what the stage worked with, and its input
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs

"""Exact dedup: two-pass Bloom filtering.

Pass 1 reads the texts once, keeps (id, SHA-256) as a narrow table, and sets bits of two filters: `once` for
hashes seen, `twice` for bits that two hashes set. Pass 2 tests each hash against `twice`. A hash whose bits
aren't all in it occurs once: its row passes straight through. Only the others are shuffled and compared by
their full SHA-256, so a filter's false positives cost time, never correctness.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, join_groups, narrow, written

BLOCK = 1 << 16  # bits of the filter that are merged as one row
MAX_BITS = 1 << 28  # 32 MB: the most that is ever broadcast, whatever the input
TASKS = 1024  # at most so many partial filters meet in the merge of a block


def filter_bits(rows: int, most: int = MAX_BITS) -> int:
    """A power of two of about 16 bits a row, within [BLOCK, most]. Beyond `most` more rows shuffle; results stay exact."""
    return min(most, max(BLOCK, 1 << (max(rows, 1) * 16 - 1).bit_length()))


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = h.astype(np.int64).view(np.uint64)
    return (u & np.uint64(bits - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _partial(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found, n = np.unique(np.concatenate(_positions(batch["h"].to_numpy(), bits)), return_counts=True)
            byte, bit = found >> 3, (1 << (found & 7)).astype(np.uint8)
            again = (n > 1) | ((once[byte] & bit) != 0)
            np.bitwise_or.at(twice, byte[again], bit[again])
            np.bitwise_or.at(once, byte, bit)
        size = BLOCK // 8
        blocks = np.unique(np.nonzero(once)[0] // size)
        for at in range(0, len(blocks), 256):
            part = blocks[at : at + 256]
            pack = lambda x: [zlib.compress(x[b * size : (b + 1) * size].tobytes(), 1) for b in part]  # noqa: B023, E731
            yield pd.DataFrame({"block": part, "once": pack(once), "twice": pack(twice)})

    return run


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    once, twice = np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
    for o, t in zip(rows["once"], rows["twice"], strict=True):
        o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
        twice |= t | (once & o)
        once |= o
    return pd.DataFrame({"block": [key[0]], "twice": [zlib.compress(twice.tobytes(), 1)]})


def repeated_filter(hashes: DataFrame, rows: int, most: int = MAX_BITS) -> np.ndarray:
    """The `twice` filter over column h (long), at most `most` bits, as bytes on the driver."""
    bits = filter_bits(rows, most)
    parts = hashes.select("h").coalesce(TASKS).mapInPandas(_partial(bits), "block long, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("block").applyInPandas(_merge, "block long, twice binary").toLocalIterator():
        out[row["block"] * (BLOCK // 8) : (row["block"] + 1) * (BLOCK // 8)] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty, so null
    and empty texts form one group. The smallest id of a group stays; a null id comes last; of rows that repeat an
    id in one group a single one is kept. Empty table: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    text = F.regexp_replace("text", SPACE, " ")
    hashed = written(narrow(df, id_col, text_col).select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "hashes")
    hashed = hashed.withColumn("h", F.xxhash64("text_sha256"))
    total = hashed.count()
    sent = spark.sparkContext.broadcast(repeated_filter(hashed, total, max_bits))

    @F.pandas_udf("boolean")
    def maybe_repeated(h: pd.Series) -> pd.Series:
        bytes_ = sent.value
        hit = np.ones(len(h), bool)
        for p in _positions(h.to_numpy(), len(bytes_) * 8):
            hit &= (bytes_[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        return pd.Series(hit)

    flagged = hashed.withColumn("maybe", maybe_repeated("h"))
    single = flagged.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = flagged.where("maybe").select("doc_id", "row", "text_sha256")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = written(rows.groupBy("text_sha256").agg(first, F.count("*").alias("group_size")), "groups")
    joined = join_groups(rows, groups, "text_sha256", "group_size", total)
    return single.unionByName(joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256"))

"""Packing documents into sequences of a fixed length: shortest-pack-first over the length histogram.

Documents are tokenised once and cut into pieces of at most the sequence length. Only the histogram of piece lengths,
at most as many rows as the length has values, reaches the driver. Lengths are placed longest first into the
shortest pack; what is kept are patterns of lengths with their counts. Patterns are then joined back: a piece's rank
among those of its length tells its sequence and offset.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.bpe import Chunks, Words, byte_letters
from ridgeline.llm.common import narrow, ranked_in_groups, written

LENGTH = 2048
END_ID = 1


@lru_cache(maxsize=2)
def library(path: str) -> Chunks:
    """Chunks whose words are encoded by the tokenizers library's own model."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_file(path).model, byte_letters()

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [[t.id for t in model.tokenize("".join([letters[b] for b in w]))] for w in words]
        return np.fromiter((i for f in found for i in f), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    return Chunks(Words(path), encode)


def pieces(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, little-endian unsigned 32-bit): a row per piece.

    Each document is its ids and then end_id; a null or empty text has end_id alone. Cuts are at multiples of `length`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = library(tokenizer)
        for b in batches:
            which, out = [], []
            for k, found in enumerate(table.of(pa.Array.from_pandas(b["text"], type=pa.string()))):
                ids = np.append(found, end_id).astype("<u4")
                for start in range(0, len(ids), length):
                    raw = ids[start : start + length].tobytes()
                    which.append(k)
                    out.append((start, len(raw) // 4, zlib.crc32(raw), len(ids), raw)[: 5 if with_ids else 4])
            frame = pd.DataFrame(out, columns=["start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 if with_ids else 4])
            frame.insert(0, "doc_id", b["doc_id"].to_numpy()[which])
            yield frame

    rows = narrow(df, id_col, text_col)
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, longest first) and how many sequences follow each; every piece is placed once."""
    packs: list[tuple[int, tuple[int, ...]]] = []  # heap by tokens used
    counts: dict[tuple[int, ...], int] = defaultdict(int)
    done: list[tuple[tuple[int, ...], int]] = []

    def keep(pattern: tuple[int, ...], n: int) -> None:
        if sum(pattern) == length:
            done.append((pattern, n))
            return
        if not counts[pattern]:
            heapq.heappush(packs, (sum(pattern), pattern))
        counts[pattern] += n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not packs or packs[0][0] + size > length:
                keep((size,), left)  # a new pack for each of the rest
                break
            _, pattern = packs[0]
            n = min(left, counts[pattern])
            counts[pattern] -= n
            if not counts[pattern]:
                heapq.heappop(packs)
                del counts[pattern]
            left -= n
            keep((*pattern, size), n)
    return done + [(p, n) for p, n in counts.items() if n]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where pieces go by length and rank: ranks low <= rank of `length` fill sequences from `first` on, `times` to each."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for pattern, n in patterns:
        offset = i = 0
        while i < len(pattern):
            size, j = pattern[i], i
            while j < len(pattern) and pattern[j] == size:
                j += 1
            rows.append((size, used[size], first, offset, j - i))
            used[size] += n * (j - i)
            offset += size * (j - i)
            i = j
        first += n
    return pd.DataFrame(rows, columns=["length", "low", "first", "offset", "times"]).sort_values(["length", "low"], ignore_index=True)


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: in each sequence offsets have no gaps; what is left of `length` is padding.

    Repeated rows are documents of their own; a null id is kept as it is. Empty table: no rows.
    """
    spark = df.sparkSession
    cut = written(pieces(df, tokenizer, length, end_id, id_col, text_col, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    total = sum(histogram.values())
    salts = max(64, min(4096, total // 100_000))
    ranked = ranked_in_groups(cut, "length", ["doc_id", "start"], F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    table = slots(shortest_pack_first(histogram, length))
    sent = spark.sparkContext.broadcast({c: table[c].to_numpy(np.int64) for c in table})

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = sent.value
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((t["length"] << 48) | t["low"], (size << 48) | rank, side="right") - 1
        k = rank - t["low"][at]
        return pd.DataFrame({"sequence_id": t["first"][at] + k // t["times"][at], "offset": t["offset"][at] + k % t["times"][at] * size})

    return ranked.withColumn("at", place("length", "rank")).select("*", "at.*").drop("at", "rank")

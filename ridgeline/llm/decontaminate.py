"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over by the training words.

Items are cut into pieces that overlap by one word less than a window, so no window is lost, and pieces are dealt into
blocks of a bounded number of words. One task builds the automaton of each block; it is sent to the executors as four
plain arrays. A document's words move through the automaton, which keeps the longest stretch of words up to here that
some item holds. Where that stretch is a window long, the window's words are hit, and the state that holds the
window's last words names the items. Documents are read once for each block; their texts are never shuffled.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import narrow, written

BLOCK_WORDS = 400_000  # item words of one automaton: some 100 MB in each worker
PIECE_WORDS = 20_000  # an item's words that stay together
ROWS = 64

#: Bytes to words: capitals become small, other ASCII but digits and letters become spaces, the rest stays.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class Builder:
    """A suffix automaton of several sequences of word numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, follows: dict[int, int], link: int) -> int:
        self.next.append(follows)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int) -> int:
        """The state of the word after state `at`, cut off at that length if longer strings share it."""
        after = self.next[at][word]
        if self.length[after] == self.length[at] + 1:
            return after
        short = self._state(self.length[at] + 1, dict(self.next[after]), self.link[after])
        self.link[after] = short
        while at >= 0 and self.next[at].get(word) == after:
            self.next[at][word] = short
            at = self.link[at]
        return short

    def add(self, words: list[int]) -> int:
        """Adds a sequence; the state of the whole of it."""
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new, at = self._state(self.length[last] + 1, {}, 0), last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, word)
            last = new
        return last

    def prefix_states(self, words: list[int]) -> Iterator[int]:
        """The state after each word of an added sequence, from its start."""
        at = 0
        for word in words:
            at = self.next[at][word]
            yield at

    def holder(self, state: int, length: int) -> int:
        """The state that holds the last `length` words of a state's strings."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


def build(pieces: list[tuple[str, bool, list[bytes]]], window: int) -> bytes:
    """The automaton of one block of (item id, is a whole item, words), as arrays."""
    numbers: dict[bytes, int] = {}
    rows = [(item, whole, [numbers.setdefault(w, len(numbers)) for w in words]) for item, whole, words in pieces]
    made = Builder()
    for _, _, words in rows:
        made.add(words)
    # Windows are named after all is added, when states split no more.
    named: set[tuple[int, int, int]] = set()  # state, length of the window, item
    items: dict[str, int] = {}
    for item, whole, words in rows:
        if len(words) >= window:
            states = list(made.prefix_states(words))[window - 1 :]
            named |= {(made.holder(s, window), window, items.setdefault(item, len(items))) for s in states}
        elif whole and words:
            *_, state = made.prefix_states(words)
            named.add((made.holder(state, len(words)), len(words), items.setdefault(item, len(items))))
    # The nearest state with a window on the way to the root, itself included; 0 is none.
    marked, nearest = {s for s, _, _ in named}, np.zeros(len(made.link), np.int64)
    for state in np.argsort(made.length, kind="stable")[1:].tolist():
        nearest[state] = state if state in marked else nearest[made.link[state]]
    moves = [(s, w, t) for s, follows in enumerate(made.next) for w, t in follows.items()]
    arrays = {"moves": np.array(moves, np.int32).reshape(-1, 3), "link": np.array(made.link, np.int32), "length": np.array(made.length, np.int32), "nearest": nearest.astype(np.int32), "named": np.array(sorted(named), np.int32).reshape(-1, 3)}
    return zlib.compress(pickle.dumps((list(numbers), list(items), arrays)), 1)


class Automaton:
    """A block's automaton as a worker uses it."""

    def __init__(self, packed: bytes) -> None:
        words, self.items, arrays = pickle.loads(zlib.decompress(packed))
        self.numbers = {w: i for i, w in enumerate(words)}
        self.width = len(words) + 1
        s, w, t = arrays["moves"].astype(np.int64).T if len(arrays["moves"]) else np.zeros((3, 0), np.int64)
        self.moves = dict(zip((s * self.width + w).tolist(), t.tolist(), strict=True))
        self.link, self.length, self.nearest = (arrays[k].tolist() for k in ("link", "length", "nearest"))
        self.windows: dict[int, dict[int, list[int]]] = {}
        for state, length, item in arrays["named"].tolist():
            self.windows.setdefault(state, {}).setdefault(length, []).append(item)

    def matched(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words (start, end) and the ids of the items whose windows occur."""
        numbers, moves, width, link, length, nearest = self.numbers, self.moves, self.width, self.link, self.length, self.nearest
        spans: list[tuple[int, int]] = []
        found: set[tuple[int, int]] = set()
        state = size = 0
        for at, w in enumerate(map(numbers.get, words)):
            if w is None:
                state = size = 0
                continue
            after = moves.get(state * width + w)
            while after is None and state:
                state = link[state]
                size = length[state]
                after = moves.get(state * width + w)
            if after is None:
                continue
            state, size = after, size + 1
            named = nearest[state]
            while named:
                for n in self.windows[named]:
                    if n <= size:
                        found.add((named, n))
                        start = at + 1 - n
                        while spans and start <= spans[-1][1]:  # ends ascend
                            start = min(start, spans.pop()[0])
                        spans.append((start, at + 1))
                named = nearest[link[named]]
        return spans, {self.items[i] for s, n in found for i in self.windows[s][n]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """block, packed: one automaton for about `block_words` words of items, built by one task each, as a written table."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for item, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, 1), piece_words):
                    part = words[at : at + piece_words + window - 1]
                    if part:
                        out.append((item if isinstance(item, str) else "", at == 0, len(part), b" ".join(part)))
            yield pd.DataFrame(out, columns=["item", "whole", "n", "words"])

    named = narrow(items, id_col, text_col).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    pieces = written(named.mapInPandas(cut, "item string, whole boolean, n long, words binary").dropDuplicates(["item", "words", "whole"]), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = -(-total // block_words)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        packed = build([(i, bool(whole), words.split(b" ")) for i, whole, words in zip(rows["item"], rows["whole"], rows["words"], strict=True)], window)
        return pd.DataFrame({"block": [key[0]], "packed": [packed]})

    return written(pieces.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(max(count, 1)))).groupBy("block").applyInPandas(one, "block long, packed binary"), "automata")


_READY: dict[str, object] = {"at": None}


def _automaton(sent: Broadcast, name: str) -> Automaton:
    """The automaton of a broadcast, unpacked once in each worker; the one before it goes."""
    if _READY["at"] != name:
        _READY.update(at=name, made=None)
        _READY["made"] = Automaton(sent.value)
    return _READY["made"]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _streamed(rows: DataFrame, packed: bytes | None, name: str, kept: list[str]) -> DataFrame:
    """rows' columns `kept`, n_words, spans and items of one automaton."""
    sent = rows.sparkSession.sparkContext.broadcast(packed) if packed is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _automaton(sent, name) if sent is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                out = []
                for text in part.column("text"):
                    words = words_of(text.as_py())
                    spans, items = table.matched(words) if table else ([], set())
                    out.append((len(words), [{"start": s, "end": e} for s, e in spans], sorted(items)))
                n, spans, items = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "spans", "items"])

    shape = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.mapInArrow(run, f"{shape}n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def contamination(df: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, spans array<struct<start, end>> of hit words (numbered from 0, end exclusive), items array<string>
    and, if asked for, text: one row per input row.

    Words are runs of digits, a-z and characters beyond ASCII, capitals A-Z being small. A window is `window` consecutive
    words of an item, or all words of a shorter item; a document's word is hit if it lies in an occurrence of a window.
    Null and empty texts have no words, items without words no windows; rows with one item id count as one item, a null
    id as ''. Repeated documents agree, null ids stay null; without documents there are no rows, without items no hits.
    Other columns are ignored. The automata of the blocks are sent one at a time, each of a bounded size.
    """
    spark = df.sparkSession
    made = blocks(items, window, item_id, item_text, block_words)
    order = [r["block"] for r in made.select("block").orderBy("block").toLocalIterator()]
    rows = narrow(df, id_col, text_col)
    kept = ["doc_id", "text"] if with_text else ["doc_id"]
    name = made.inputFiles()[0] if order else ""
    packed = lambda block: bytes(made.where(F.col("block") == block).first()["packed"])
    if len(order) < 2:
        return _streamed(rows, packed(order[0]) if order else None, name, kept)
    # Several blocks: rows get a number, and each block's finds meet by it.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for block in order:
        part = written(_streamed(rows, packed(block), f"{name}#{block}", ["row"]).where("size(spans) > 0"), "hits")
        found = part if found is None else found.unionByName(part)

    @F.pandas_udf("array<struct<start: long, end: long>>")
    def joined(spans: pd.Series) -> pd.Series:
        return spans.map(lambda found: [{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in found])])

    hits = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    bare = _streamed(rows, None, "", ["row", *kept]).drop("spans", "items")

    def none(c: str, kind: str):
        return F.coalesce(c, F.array().cast(kind)).alias(c)

    return bare.join(hits.withColumn("spans", joined("spans")), "row", "left").select(*kept, "n_words", none("spans", "array<struct<start: long, end: long>>"), none("items", "array<string>"))


def decontaminate(df: DataFrame, items: DataFrame, window: int = 10, longest: int = 0, coverage: float = 1.0, **columns: str) -> DataFrame:
    """What contamination() gives, with kept boolean and the text without its spans of more than `longest` words.

    A document of which more than `coverage` of the words are hit is not to be kept (kept is false); its text is cut
    like any other. A span goes from its first word's first byte to its last word's last; what stands around it stays,
    joined by nothing. Null texts count as empty.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(s["start"], s["end"]) for s in found if s["end"] - s["start"] > longest]) for t, found in zip(text, spans, strict=True)])

    found = contamination(df, items, window, with_text=True, **columns)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    any_long = F.exists("spans", lambda s: s["end"] - s["start"] > longest)
    return found.withColumn("kept", hit <= F.col("n_words") * coverage).withColumn("text", F.when(any_long, cut("text", "spans")).otherwise(F.col("text")))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.translate(_PLAIN))]
    out, at = [], 0
    for start, end in spans:
        out.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")

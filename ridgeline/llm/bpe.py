"""BPE encoding by a pair occurrence index, and decoding, for word-level BPE with a word-end suffix.

A block of documents is cut into chunks at white space; each distinct new chunk is normalised, split into words, and
all words of the block are merged together: an index maps each pair's rank to all positions of that pair. Ranks are
applied in ascending order, at all their positions at once; every merge puts the pairs it makes on their own lists.
Vocabularies of this kind make a token by one merge only, and use it in later merges only, so the order over the
block is each word's own order.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import narrow

#: When a worker knows more chunks than this, it keeps those that its last stretch of texts had more than once.
REMEMBERED = 400_000
#: Bytes of text whose chunks are told apart at once; a longer text is a stretch of its own.
STRETCH = 8 << 20
#: Marks that are words of their own after letters.
MARKS = frozenset(".,;:!?)")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words:
    """What the tokenizer's file says of normalising and splitting."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.letters = byte_letters()

    def split(self, chunk: str) -> list[str | int]:
        """Words of a chunk without ASCII white space, as text; ids of special tokens in it."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in MARKS:
                return [chunk[:-1].lower(), chunk[-1]]
        out: list[str | int] = []
        for part in self.around(chunk) if "<|" in chunk else (chunk,):
            out += [self.special[part]] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma is lower-cased by itself, wherever it stands
        text = text.lower()
        return [text] if text.isalpha() else self.find(text)


class PairIndex:
    """Merges the words of a block."""

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = self.left * self.size + self.right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        if not n:
            return np.zeros(0, np.int32), lengths
        ends = np.cumsum(lengths[lengths > 0]) - 1
        sym = self.inner[text]
        sym[ends] = self.last[text[ends]]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends] = n  # a stop after the last symbol: its symbol is -1
        prv[np.concatenate([[0], ends[:-1] + 1])] = n
        sym, nxt, prv = np.append(sym, np.int32(-1)), np.append(nxt, n), np.append(prv, n)
        lists: dict[int, list[np.ndarray]] = {}

        def index(at: np.ndarray) -> None:
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.nonzero(rank[1:] != rank[:-1])[0] + 1
            for r, part in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut) if len(cut) else (at,), strict=True):
                lists.setdefault(r, []).append(part)

        inside = np.ones(n, bool)
        inside[ends] = False
        index(np.nonzero(inside)[0])
        for rank in range(len(self.made)):
            if rank not in lists:
                continue
            parts = lists.pop(rank)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            a, b = self.left[rank], self.right[rank]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if len(parts) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:  # in a run of the symbol every second position, from the left
                follows = np.append(False, at[1:] == nxt[at[:-1]])
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = self.made[rank], -1
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            before = before[before < n]
            index(np.concatenate([before, at[after < n]]))
        kept = np.nonzero(sym[:n] >= 0)[0]
        counts = np.bincount(np.repeat(np.arange(len(words)), lengths)[kept], minlength=len(words))
        return sym[kept], counts


class Chunks:
    """Ids of chunks, by chunk; each worker's own. encode: ids and their counts of a list of words as bytes."""

    def __init__(self, words: Words, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.words, self.encode = words, encode
        self.at: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, chunks: list[str]) -> None:
        """Adds chunks that are not there yet."""
        chunks = [c for c in chunks if c not in self.at]
        if not chunks:
            return
        split = [self.words.split(c) for c in chunks]
        distinct = dict.fromkeys(w for s in split for w in s if isinstance(w, str))
        ids, counts = self.encode([w.encode("utf-8", "surrogatepass") for w in distinct])
        starts = np.cumsum(counts) - counts
        place: dict[str | int, int] = {w: i for i, w in enumerate(distinct)}
        # One entry for each word or special token of each chunk, in order.
        special = sorted(self.words.special.values())
        ids, starts, counts = np.append(ids, np.array(special, np.int32)), np.append(starts, len(ids) + np.arange(len(special))), np.append(counts, np.ones(len(special), np.int64))
        place |= {s: len(distinct) + i for i, s in enumerate(special)}
        per = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(per.sum()))
        values = gather(ids, starts[flat], counts[flat])
        sums = np.append(0, np.cumsum(counts[flat]))
        upto = np.append(0, np.cumsum(per))
        lengths = sums[upto[1:]] - sums[upto[:-1]]
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks)), strict=True))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.ids = np.append(self.ids, values)

    def keep(self, chunks: list[str], at: np.ndarray) -> None:
        """Forgets all but these chunks, which stand at these places."""
        starts, self.lengths = self.starts[at], self.lengths[at]
        self.ids = gather(self.ids, starts, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.at = dict(zip(chunks, range(len(chunks)), strict=True))

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; no text may be null. Chunks are told apart stretch by stretch, not text by text."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + STRETCH, side="right")))
            lists = pc.ascii_split_whitespace(texts.slice(low, high - low))
            flat = lists.flatten().dictionary_encode()
            chunks, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
            self.learn(chunks)
            at = np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))
            if len(self.at) > REMEMBERED:
                often = np.nonzero(np.bincount(index, minlength=len(chunks)) > 1)[0]
                starts, lengths, ids = self.starts[at], self.lengths[at], self.ids
                self.keep([chunks[i] for i in often.tolist()], at[often])
            else:
                starts, lengths, ids = self.starts[at], self.lengths[at], self.ids
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                which = index[x:y]
                yield gather(ids, starts[which], lengths[which])
            low = high


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each s and n, one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


@lru_cache(maxsize=2)
def indexed(path: str) -> Chunks:
    words = Words(path)
    return Chunks(words, PairIndex(words.model).encode)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: one row per input row, without special tokens added; null and empty texts have no ids.

    tokenizer: path of the vocabulary file, readable on every executor. Repeated rows stay and agree; an empty table
    gives no rows; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = indexed(tokenizer)
        for b in batches:
            at = 0
            for found in encoded(table, b.column("text")):
                ends = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(found)), ids], ["doc_id", "ids"])
                at += len(found)

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def encoded(table: Chunks, texts: pa.Array, rows: int = 512) -> Iterator[list[np.ndarray]]:
    """The ids of the texts, `rows` texts at a time."""
    found = table.of(texts)
    while part := list(islice(found, rows)):
        yield part


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    words = Words(path)
    names = {i: t for t, i in (words.model["vocab"] | words.special).items()}
    return [names.get(i, "") for i in range(max(names) + 1)]


def decoded(ids: np.ndarray, names: list[str]) -> str:
    """The text of ids: the vocabulary has no decoder, so tokens are joined by one space; ids outside it are nothing."""
    return " ".join([names[i] for i in ids.tolist() if 0 <= i < len(names)])


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of df, with the text of its ids, special tokens included, as column `out`, which it replaces if df has
    one. Null ids give null, ids outside the vocabulary nothing."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        names = vocabulary(tokenizer)
        return ids.map(lambda x: None if x is None else decoded(x, names))

    return df.withColumn(out, text(ids_col))


def round_trip(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() and then decode() give, as digests, one row per input row.

    Ids and decoded texts stay in the Python worker, a few hundred documents of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = indexed(tokenizer), vocabulary(tokenizer)
        numbers = [str(i) for i in range(len(names))]
        digest = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            at = 0
            for found in encoded(table, b.column("text"), 64):
                rows = [(len(ids), digest(" ".join([numbers[i] for i in ids.tolist()])), digest(decoded(ids, names))) for ids in found]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(found)), *map(pa.array, zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(found)

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

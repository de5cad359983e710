"""Suffix-array dedup: bytes that repeat a window of an earlier document, by a depth-limited radix sort.

Suffixes are ordered only through `WINDOW` bytes, most significant digit first; groups that stay equal through all
digits are exactly the repeated windows. The first digit is chosen so that a shuffle can deal suffixes out without
moving most of them: each window's anchor, its gram of GRAM bytes with the smallest hash (the leftmost such). Equal
windows have equal anchors at equal offsets, neighbouring windows mostly share one. A bounded two-level Bloom filter
over anchors drops windows whose anchor occurs once. The rest travel as stretches of text, one for a run of windows
with a common anchor, to the task of that anchor; there the remaining digits, 8 bytes each, are sorted pass by pass,
and groups of one document leave at every pass. Stretches equal to one of an earlier document of the same batch are
settled before the shuffle, so a passage that a third of all documents share sends one stretch from each batch.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import narrow
from ridgeline.llm.exact_dedup import MAX_BITS, TASKS, _merge, _partial, _positions, filter_bits

WINDOW = 50
GRAM = 24
PART = 1 << 18  # windows hashed at once
LAST = (1 << 63) - 1  # stands for a null id, which comes last
BUCKET_BYTES = 4 << 20  # text per bucket of anchors
BLOCK_BYTES = 4 << 20  # characters of documents that a task handles at once, about
_MIX, _FACTOR = np.uint64(0xBF58476D1CE4E5B9), 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each stretch of `gram` bytes, from hashes of stretches of 1, 2, 4, ... bytes."""
    power, size, left, out, got = data.astype(np.uint64) + np.uint64(1), 1, gram, None, 0
    join = lambda a, b, at, n: a[: len(data) - n + 1] * np.uint64(pow(_FACTOR, n - at, 1 << 64)) + b[at : at + len(data) - n + 1]
    while left:
        if left & 1:
            out = power if out is None else join(out, power, got, got + size)
            got += size
        left >>= 1
        if left:
            power, size = join(power, power, size, size * 2), size * 2
    out = out ^ (out >> np.uint64(29))
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        v, n = np.minimum(v[:-n], v[n:]), n * 2
    return np.minimum(v[: len(v) - (width - n)], v[width - n :]) if n < width else v


def stretches(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, last window, anchor's hash, anchor's place) of each run of windows with one anchor; no window crosses documents."""
    n = len(data)
    if n < window:
        return
    marks = np.zeros(n + 1, np.int8)
    own = lengths >= window
    np.add.at(marks, starts[own], 1)
    np.add.at(marks, starts[own] + lengths[own] - window + 1, -1)
    inside = np.cumsum(marks[:-1], dtype=np.int8) > 0
    low = np.uint64(PART * 2 - 1)
    for at in range(0, n - window + 1, PART):
        part = data[at : at + PART + window - 1]
        ok = inside[at : at + len(part) - window + 1]
        if not ok.any():
            continue
        h = gram_hashes(part, gram)
        least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
        fresh = ok.copy()
        fresh[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
        stop = ok.copy()
        stop[:-1] &= fresh[1:] | ~ok[1:]
        first = np.nonzero(fresh)[0]
        anchor = (least[first] & low).astype(np.int64)
        yield at + first, at + np.nonzero(stop)[0], h[anchor], at + anchor


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their bytes, starts, lengths), some BLOCK_BYTES of text at a time."""
    for whole in batches:
        sizes = np.fromiter((len(t or "") for t in whole.column("text").to_pylist()), np.int64, len(whole))
        block = np.cumsum(sizes) // BLOCK_BYTES
        cuts = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1, [len(whole)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            b = whole.slice(lo, hi - lo)
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            yield b, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for _, data, starts, lengths in _batches(batches):
        for _, _, h, _ in stretches(data, starts, lengths):
            yield pd.DataFrame({"h": h.view(np.int64)})


#: Columns of a packed set of stretches: document, its twin hash, first byte, length, place of the anchor (SETTLED: no text follows).
_PACKED = (("id", "<i8"), ("twin", "<i8"), ("at", "<i8"), ("size", "<u4"), ("anchor", "u1"))
SETTLED = 255


def _pack(columns: dict[str, np.ndarray], bodies: list[bytes]) -> bytes:
    raw = [columns[c].astype(t).tobytes() for c, t in _PACKED]
    return zstandard.compress(b"".join([len(columns["id"]).to_bytes(8, "little"), *raw, *bodies]), 3)


def _unpack(packed: bytes) -> tuple[pd.DataFrame, list[bytes]]:
    raw = zstandard.decompress(packed)
    n, at, columns = int.from_bytes(raw[:8], "little"), 8, {}
    for c, t in _PACKED:
        columns[c] = np.frombuffer(raw, t, n, at).astype(np.int64)
        at += columns[c].size * np.dtype(t).itemsize
    sizes = np.where(columns["anchor"] == SETTLED, 0, columns["size"])
    ends = (at + np.cumsum(sizes)).tolist()
    return pd.DataFrame(columns), [raw[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)]


def _candidates(sent, buckets: int):  # noqa: ANN001
    """Stretches whose anchor may repeat, those of one bucket and block packed into a row; settled spans go without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = sent.value
        for b, data, starts, lengths in _batches(batches):
            ids, twins, raw = b.column("id").to_numpy(), b.column("twin").to_numpy(), data.tobytes()
            found = []
            for first, last, h, anchor in stretches(data, starts, lengths):
                hit = np.ones(len(h), bool)
                for p in _positions(h.view(np.int64), len(twice) * 8):
                    hit &= (twice[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
                found.append((first[hit], last[hit], h[hit], anchor[hit]))
            if not found:
                continue
            first, last, gram, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
            doc = np.searchsorted(starts + lengths, first, side="right")
            bodies = [raw[i : j + WINDOW] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
            slot: dict[bytes, int] = {}
            of = np.fromiter((slot.setdefault(x, len(slot)) for x in bodies), np.int64, len(bodies))
            least = np.full(len(slot), LAST)
            np.minimum.at(least, of, ids[doc])
            settled = ids[doc] > least[of]
            columns = {"id": ids[doc], "twin": twins[doc], "at": first - starts[doc], "size": last - first + WINDOW, "anchor": np.where(settled, SETTLED, anchor - first)}
            i = np.nonzero(settled)[0]
            if len(i):  # neighbouring settled spans of a document become one
                i = i[np.argsort(first[i], kind="stable")]
                begin, end, d = first[i], last[i] + WINDOW, doc[i]
                heads = np.nonzero(np.append(True, (d[1:] != d[:-1]) | (begin[1:] > end[:-1])))[0]
                tails = np.append(heads[1:] - 1, len(i) - 1)
                columns["size"][i[heads]] = end[tails] - begin[heads]
                keep = np.sort(np.concatenate([np.nonzero(~settled)[0], i[heads]]))
            else:
                keep = np.arange(len(first))
            bucket = (gram % np.uint64(buckets)).astype(np.int64)[keep]
            order = np.argsort(bucket, kind="stable")
            keep, bucket = keep[order], bucket[order]
            heads = np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0][: len(keep)]
            packed = [_pack({c: v[k] for c, v in columns.items()}, [bodies[x] for x in k[~settled[k]].tolist()]) for k in np.split(keep, heads[1:])] if len(keep) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    return run


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, ids: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window (its place in data, its group by the first digit, its document) the least document with equal bytes.

    Most significant digit first, 8 bytes a pass; windows whose group holds a single document leave at once.
    """
    least = ids.copy()
    words = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, np.uint8)).view(np.uint8), (len(data) + 1, 8), (1, 1))
    live = np.arange(len(at))
    offsets = [None, *range(0, window - 7, 8)] + ([window - 8] if window % 8 else [])
    for offset in offsets:
        if offset is not None:
            digit = np.ascontiguousarray(words[at[live] + offset]).view(">u8").ravel().astype(np.uint64)
            order = np.lexsort((digit, group))
            digit = digit[order]
        else:
            order = np.argsort(group, kind="stable")
            digit = np.zeros(len(live), np.uint64)
        live, group = live[order], group[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))[: len(live)]
        heads = np.nonzero(new)[0]
        if not len(heads):
            return least
        low, high = np.minimum.reduceat(ids[live], heads), np.maximum.reduceat(ids[live], heads)
        group = np.cumsum(new) - 1
        if offset == offsets[-1]:
            least[live] = low[group]
            return least
        several = (low != high)[group]
        live, group = live[several], group[several]
    return least


def _settle(key: tuple, packed: pd.DataFrame) -> pd.DataFrame:
    """Spans of the stretches of one bucket of anchors that an earlier document has, and spans settled before."""
    parts = [_unpack(p) for p in packed["packed"]]
    rows = pd.concat([p[0] for p in parts], ignore_index=True)
    rows["upto"] = rows["at"] + rows["size"]
    empty = (rows["anchor"] == SETTLED).to_numpy()
    rows["body"] = [x for p in parts for x in p[1]]
    early = rows[empty]
    rows = rows[~empty]
    out = [early[["id", "twin", "at", "upto"]]]
    if len(rows):
        ids, anchor, begin = (rows[c].to_numpy(np.int64) for c in ("id", "anchor", "at"))
        slot: dict[bytes, int] = {}
        of = np.fromiter((slot.setdefault(x, len(slot)) for x in rows["body"]), np.int64, len(rows))
        least = np.full(len(slot), LAST)
        np.minimum.at(least, of, ids)
        out.append(rows.iloc[np.nonzero(ids > least[of])[0]][["id", "twin", "at", "upto"]])
        # Windows of distinct stretches, by anchor.
        bodies = list(slot)
        some = np.zeros(len(slot), np.int64)
        some[of] = np.arange(len(rows))
        size = np.fromiter(map(len, bodies), np.int64, len(bodies))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(bodies), np.uint8)
        count = size - WINDOW + 1
        owner = np.repeat(np.arange(len(bodies)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[owner]
        first = radix_groups(data, place, np.unique(gram_hashes(data, GRAM)[start + anchor[some]], return_inverse=True)[1][owner], least[owner])
        hit = first < least[owner]
        if hit.any():
            new = hit & np.append(True, ~hit[:-1] | (owner[1:] != owner[:-1]))
            end = hit & np.append(~hit[1:] | (owner[1:] != owner[:-1]), True)
            i, j = np.nonzero(new)[0], np.nonzero(end)[0]
            runs = pd.DataFrame({"of": owner[i], "from": place[i] - start[owner[i]], "to": place[j] - start[owner[j]] + WINDOW})
            own = pd.DataFrame({"of": of, "id": ids, "twin": rows["twin"].to_numpy(), "begin": begin})[ids == least[of]]
            both = own.merge(runs, on="of")
            out.append(pd.DataFrame({"id": both["id"], "twin": both["twin"], "at": both["begin"] + both["from"], "upto": both["begin"] + both["to"]}))
    found = pd.concat(out)
    return pd.DataFrame({"id": found["id"].to_numpy(np.int64), "twin": found["twin"].to_numpy(np.int64), "span": (found["at"].to_numpy(np.int64) << 32) | found["upto"].to_numpy(np.int64)})


def repeated_spans(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, twin, span): byte spans begin << 32 | end, overlapping or not, of documents (id long, twin long, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(int(size * 0.08), max_bits)

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _partial(bits)(_anchors(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("block", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())]), preserve_index=False)

    twice = np.zeros(bits // 8, np.uint8)
    parts = docs.select("text").coalesce(TASKS).mapInArrow(filters, "block long, once binary, twice binary")
    for row in parts.groupBy("block").applyInPandas(_merge, "block long, twice binary").toLocalIterator():
        found = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        twice[row["block"] * len(found) : (row["block"] + 1) * len(found)] = found
    buckets = max(64, size // BUCKET_BYTES)
    dealt = docs.mapInArrow(_candidates(spark.sparkContext.broadcast(twice), buckets), "bucket long, packed binary")
    return dealt.groupBy("bucket").applyInPandas(_settle, "id long, twin long, span long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes), spans.

    A byte is removed if a 50-byte window over it also starts in a document with a smaller id. Null text counts as
    empty; texts under 50 bytes keep all. A null id comes after all others. Rows that repeat an id don't remove each
    other's bytes. spans: array of begin << 32 | end of maximal removed runs. Empty table: no rows.
    """
    docs = narrow(df, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("twin"), "text")
    found = repeated_spans(docs, max_bits).groupBy("id", "twin").agg(F.collect_list("span").alias("found"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["found"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if spans is None:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw, []))
                    continue
                marks = np.zeros(len(raw) + 1, np.int64)
                np.add.at(marks, spans >> 32, 1)
                np.add.at(marks, spans & 0xFFFFFFFF, -1)
                gone = np.cumsum(marks[:-1]) > 0
                edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
                begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept, (begin << 32 | end).tolist()))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
            frame.insert(0, "doc_id", b["id"].astype("Int64").mask(b["id"] == LAST))
            yield frame

    joined = docs.join(found, ["id", "twin"], "left").select("id", "text", "found")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>")

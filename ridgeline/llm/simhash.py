"""SimHash fingerprints and near-duplicate components by a binary trie self-join.

The distinct fingerprints, sorted, are a binary trie: a node is a range that shares its leading bits. Pairs of
nodes are traversed together from the root; a pair carries the number of bits in which its two prefixes differ
and is dropped as soon as that exceeds the budget. Spark deals the work out by pairs of nodes at a depth that
follows the number of fingerprints; inside a task the pairs are numpy arrays, handled in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import components, join_groups, narrow, written

BUDGET = 2
CHUNK = 1 << 18  # node pairs handled at once
PER_NODE = 40_000  # fingerprints below a node at which tasks are dealt out, about
LEAST_DEPTH = 6  # of the nodes that are dealt out
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 if there is no word. Bit set: in over half the hashes."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() splits at 0x20, 0x09-0x0D
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_of(text: Column, shingle: int = 3) -> Column:
    """The 64 bits as a signed long; null text counts as empty."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", shingle) for t in text], np.uint64).view(np.int64))

    return fp(text)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp: one row per input row."""
    return narrow(df, id_col, text_col).select("doc_id", fingerprint_of(F.col("text"), shingle).alias("fp"))


def _expand(la: np.ndarray, ha: np.ndarray, lb: np.ndarray, hb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    na, nb = ha - la, hb - lb
    count = na * nb
    which = np.repeat(np.arange(len(la)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return la[which] + k // nb[which], lb[which] + k % nb[which]


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in a, j in b) whose values differ in at most `budget` bits, each once; a and b sorted, distinct uint64.

    All of a share their first `depth` bits, so do all of b. same: a is b, and i < j.
    """
    if not len(a) or not len(b):
        return
    start = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    if start > budget:
        return
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b), start)))]
    while stack:
        level, la, ha, lb, hb, diff = stack.pop()
        if len(la) > CHUNK:
            for at in range(0, len(la), CHUNK):
                stack.append((level, *(x[at : at + CHUNK] for x in (la, ha, lb, hb, diff))))
            continue
        small = ((ha - la) * (hb - lb) <= 24) | (level >= 64)
        if small.any():
            i, j = _expand(la[small], ha[small], lb[small], hb[small])
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            la, ha, lb, hb, diff = (x[~small] for x in (la, ha, lb, hb, diff))
        if not len(la):
            continue
        bit = np.uint64(63 - level)
        middle = lambda v, lo, hi: np.clip(np.searchsorted(v, ((v[lo] >> bit) | np.uint64(1)) << bit), lo, hi)  # noqa: B023, E731
        ma, mb = middle(a, la, ha), middle(b, lb, hb)
        own = same & (la == lb)
        found = []
        for x0, x1, y0, y1, more, skip in ((la, ma, lb, mb, 0, False), (ma, ha, mb, hb, 0, False), (la, ma, mb, hb, 1, False), (ma, ha, lb, mb, 1, own)):
            ok = (x1 > x0) & (y1 > y0) & (diff + more <= budget) & ~np.asarray(skip)
            found.append([v[ok] for v in (x0, x1, y0, y1, diff + more)])
        stack.append((level + 1, *(np.concatenate(v) for v in zip(*found, strict=True))))


class _Sets:
    """Disjoint sets over 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            pi, pj = self.parent[i], self.parent[j]
            open_ = pi != pj
            if not open_.any():
                return
            i, j, pi, pj = i[open_], j[open_], pi[open_], pj[open_]
            np.minimum.at(self.parent, np.maximum(pi, pj), np.minimum(pi, pj))
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


def _dealt(order: list[int], depth: int, budget: int):
    """Each fingerprint, its bits reordered, to every pair of nodes (a <= b) at `depth` that it may have partners in."""

    def near(prefix: np.ndarray) -> Iterator[np.ndarray]:
        flips = [0] + [1 << i for i in range(depth)] * (budget >= 1) + [(1 << i) | (1 << j) for i in range(depth) for j in range(i)] * (budget >= 2)
        more = [m for k in range(3, budget + 1) for m in _choose(depth, k)]
        for flip in flips + more:
            yield prefix ^ flip

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, order]
            key = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64).ravel()  # order: bit 63 is the trie's first
            prefix = (key >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)
            for other in near(prefix):
                yield pd.DataFrame({"a": np.minimum(prefix, other), "b": np.maximum(prefix, other), "key": key.view(np.int64), "fp": b["fp"]})

    return run


def _choose(n: int, k: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << i for i in c) for c in combinations(range(n), k)]


def _links(depth: int, budget: int):
    def run(pair: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        key, fp = rows["key"].to_numpy(np.int64).view(np.uint64), rows["fp"].to_numpy(np.int64)
        order = np.argsort(key)
        key, fp = key[order], fp[order]
        cut = len(key) if pair[0] == pair[1] else int(np.searchsorted(key, np.uint64(pair[1] << (64 - depth))))
        sets = _Sets(len(key))
        one, two = key[:cut], key if pair[0] == pair[1] else key[cut:]
        for i, j in trie_pairs(one, two, depth, budget, pair[0] == pair[1]):
            sets.join(i, j if pair[0] == pair[1] else j + cut)
        linked = np.nonzero(sets.parent != np.arange(len(key)))[0]
        return pd.DataFrame({"u": fp[linked], "v": fp[sets.parent[linked]]})

    return run


def fingerprint_links(fps: DataFrame, count: int, budget: int = BUDGET, per_node: int = PER_NODE) -> DataFrame:
    """(u, v) pairs that span every component of the distinct fingerprints fp under links of at most `budget` bits."""
    depth = max(LEAST_DEPTH, (max(count, 1) // per_node).bit_length())
    # The most balanced bits come first in the trie, so that nodes at `depth` hold about as many fingerprints each.
    sums = fps.agg(*(F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))) for i in range(64))).first()
    balance = sorted(range(64), key=lambda i: abs((sums[i] or 0) * 2 - count))
    dealt = fps.select("fp").mapInPandas(_dealt(balance[::-1], depth, budget), "a long, b long, key long, fp long")
    return dealt.groupBy("a", "b").applyInPandas(_links(depth, budget), "u long, v long")


def _components_of(docs: DataFrame, budget: int, per_node: int) -> tuple[DataFrame, int]:
    """(fp, copies, component_id, kept) per distinct fingerprint of docs (doc_id, fp, place), and the number of docs.

    kept is the place of the row that stays for its component, null if that row has another fingerprint.
    """
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("best")
    fps = written(docs.groupBy("fp").agg(best, F.count("*").alias("copies")), "distinct")
    count, total = fps.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if not total:
        return fps.select("fp", "copies", F.col("best.doc_id").alias("component_id"), F.col("best.place").alias("kept")), 0
    roots = components(fingerprint_links(fps, count, budget, per_node))
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("best").alias("of"))
    of = linked.join(least, "root").select("fp", "of")
    whole = fps.join(of, "fp", "left").withColumn("of", F.coalesce("of", "best"))
    return written(whole.select("fp", "copies", F.col("of.doc_id").alias("component_id"), F.when(F.col("of.place") == F.col("best.place"), F.col("of.place")).alias("kept")), "components"), total


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET, per_node: int = PER_NODE) -> DataFrame:
    """One row per input row: doc_id, fp long, component_id (smallest id reachable over links of at most `budget` bits).

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id keep their fingerprint; a
    component of null ids alone has a null component_id. Repeated rows share a component. Empty table: no rows.
    """
    docs = written(fingerprints(df, id_col, text_col, shingle).withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    groups, total = _components_of(docs, budget, per_node)
    return join_groups(docs, groups, "fp", "copies", total).select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = BUDGET, per_node: int = PER_NODE) -> DataFrame:
    """One row of df for each component of near_duplicates(): that of the smallest id, null ids last; of rows that
    repeat this id a single one. All columns stay as they are. Empty table: no rows."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(v) for c, v in names.items()))
    rows = written(rows.withColumn("fp", fingerprint_of(F.col(names[text_col]), shingle)).withColumn("place", F.monotonically_increasing_id()), "near-input")
    groups, _ = _components_of(rows.select(F.col(names[id_col]).alias("doc_id"), "fp", "place"), budget, per_node)
    stay = groups.where("kept is not null").select(F.col("kept").alias("place"))
    return rows.join(stay, "place", "left_semi").select(*(F.col(v).alias(c) for c, v in names.items()))

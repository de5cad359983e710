"""Periodic runs of words: Lyndon stacks under both orders, stretches compared by rolling hashes.

A run's repeating part is the longest Lyndon word at some place of it, under one order of the words or under the
reverse one. Scanning from right to left, a stack of starts gives each place the end of its longest Lyndon word; two
suffixes are compared by the length of their common beginning, found by doubling and binary search over rolling
hashes and then verified word by word, so a hash that agrees by chance changes nothing. Each Lyndon word is extended
both ways in the same manner; a stretch that is long enough for its period is a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACE, narrow

MODULUS, BASE = (1 << 31) - 1, 1_000_003
DIRECT = 4  # so many words are compared one by one before hashes are
ROWS = 64  # results held at a time

Run = tuple[int, int, int]  # start, length, period


@lru_cache(maxsize=1)
def _powers(log: int) -> np.ndarray:
    """BASE ** k modulo MODULUS for k < 2 ** log."""
    out = np.ones(1, np.int64)
    step = BASE
    for _ in range(log):
        out = np.concatenate([out, out * step % MODULUS])
        step = step * step % MODULUS
    return out


class Stretches:
    """How far words of a text equal those d places on, ahead of a place and behind it."""

    def __init__(self, ids: list[int]) -> None:
        self.ids, self.n = ids, len(ids)
        self.known: dict[int, tuple[int, int]] = {}  # d -> the stretch last found: verified, and ended by a difference
        self.sums = self.powers = None

    def _hashed(self) -> None:
        log = max(1, self.n.bit_length())
        # Powers for the next few sizes are kept, so that texts of like length share them.
        powers = _powers(max(log, 16))
        sums = np.zeros(self.n + 1, np.int64)
        np.cumsum((np.array(self.ids, np.int64) + 1) % MODULUS * powers[: self.n] % MODULUS, out=sums[1:])
        self.sums, self.powers = memoryview(sums), memoryview(powers)

    def _same(self, i: int, d: int, length: int) -> bool:
        """By hash: words i .. i + length equal those d on. Never wrong when they are equal."""
        s = self.sums
        return (s[i + length] - s[i]) * self.powers[d] % MODULUS == (s[i + d + length] - s[i + d]) % MODULUS

    def ahead(self, i: int, d: int) -> int:
        """How many words from i on equal those d places later."""
        ids, most = self.ids, self.n - d - i
        k, near = 0, min(most, DIRECT)
        while k < near and ids[i + k] == ids[i + d + k]:
            k += 1
        if k < near or k == most:
            return k
        start, end = self.known.get(d, (-1, -1))
        if not start <= i + k <= end:
            if self.sums is None:
                self._hashed()
            length = self._search(k, most, lambda m: self._same(i, d, m))
            if i + k < start <= i + length:  # the rest is known
                length = self._verified(i, d, k, start - i)
                end = end if length == start - i else i + length
            else:
                end = i + self._verified(i, d, k, length)
        self.known[d] = (i, end)
        return end - i

    def behind(self, i: int, d: int) -> int:
        """How many words before i equal those d places later."""
        ids, most = self.ids, min(i, self.n - d)
        k, near = 0, min(most, DIRECT)
        while k < near and ids[i - 1 - k] == ids[i - 1 - k + d]:
            k += 1
        if k < near or k == most:
            return k
        if self.sums is None:
            self._hashed()
        length = self._search(k, most, lambda m: self._same(i - m, d, m))
        if ids[i - length : i - k] != ids[i - length + d : i - k + d]:
            length = next(m for m in range(k, length) if ids[i - 1 - m] != ids[i - 1 - m + d])
        return length

    @staticmethod
    def _search(good: int, most: int, same) -> int:
        """The greatest length for which `same` holds, by doubling and then by halves; `good` is known to hold."""
        step = max(good, 1)
        while good + step <= most and same(good + step):
            good += step
            step *= 2
        bad = min(good + step, most + 1)
        while bad - good > 1:
            middle = (good + bad) // 2
            good, bad = (middle, bad) if same(middle) else (good, middle)
        return good

    def _verified(self, i: int, d: int, low: int, high: int) -> int:
        """high, or less if words from low to high aren't all equal."""
        ids = self.ids
        if ids[i + low : i + high] == ids[i + d + low : i + d + high]:
            return high
        return next(m for m in range(low, high) if ids[i + m] != ids[i + d + m])


def lyndon_ends(ids: list[int], stretches: Stretches) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there, in the order of the ids."""
    n = len(ids)
    row = [*ids, min(ids, default=0) - 1]  # the end is less than every word
    ends, ahead = [n] * n, stretches.ahead
    for i in range(n - 2, -1, -1):
        x, j = row[i], i + 1
        while True:
            y = row[j]
            if y < x:
                break
            if y == x:
                same = ahead(i, j - i)
                if row[j + same] < row[i + same]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(ids: list[int], least: int = 12) -> list[Run]:
    """All runs of at least `least` words, and of two periods or more, by start and then period."""
    n, found = len(ids), set()
    if n < least:
        return []
    stretches = Stretches(ids)
    row, at = np.array(ids, np.int64), np.arange(n)
    last: dict[int, tuple[int, int]] = {}
    for order in (ids, [-x for x in ids]):
        ends = np.array(lyndon_ends(order, stretches), np.int64)
        # Words that extend in neither direction are no runs: their stretch is empty.
        goes_on = (row[np.minimum(ends, n - 1)] == row) & (ends < n)
        goes_on[1:] |= row[:-1] == row[ends[1:] - 1]
        for i, j in zip(at[goes_on][::-1].tolist(), ends[goes_on][::-1].tolist(), strict=True):
            d = j - i
            start, end = last.get(d, (0, -1))
            if start <= i <= end:
                continue  # in the stretch that this period had before
            start, end = i - stretches.behind(i, d), i + stretches.ahead(i, d)
            last[d] = (start, end)
            if end - start >= max(d, least - d):
                found.add((start, end - start + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Equal words, equal numbers."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(steps)[:-1].tolist(), strict=True) if not inside]


def periodic_runs(df: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs array<struct<start, length, period>> by start and period, collapsed: the text without repeated periods.

    Words are what white space (space, tab to carriage return) separates; a run is a longest stretch of words with a
    smallest period of which it holds two or more, and `least` words or more. `collapsed` keeps each run's first period
    and all words outside runs, joined by one space. One row per input row: null, empty and blank texts have no runs
    and collapse to an empty text, repeated rows agree, null ids stay null, an empty table gives none, other columns
    are ignored. A text is one task's work whatever its length, in memory of some hundred bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                runs, texts = [], []
                for text in part.column("text"):
                    words = text.as_py().encode("utf-8", "surrogatepass").split()
                    of = runs_of(numbered(words), least)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in of])
                    texts.append(b" ".join(collapsed(words, of)))
                shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(runs, shape), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = narrow(df, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def made_periodic(text: Column, seed: Column) -> Column:
    """text with its words from number a on made to repeat with a period p, both from the seed, where 10 divides it.

    With g = seed // 10 and n words: a = g % n, p = 1 + (n - a) // (3 + g % 8); word i >= a becomes word a + (i - a) % p.
    Other texts, texts without words and those with a null seed stay as they are.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    g = F.floor(seed / 10)
    values = F.named_struct(F.lit("w"), words, F.lit("a"), F.pmod(g, F.size(words).cast("long")), F.lit("g"), g)
    # One-row arrays bind names: first the words and a, then p.
    bound = F.transform(F.array(values), lambda v: F.named_struct(F.lit("w"), v["w"], F.lit("a"), v["a"], F.lit("p"), F.lit(1) + F.floor((F.size(v["w"]) - v["a"]) / (F.lit(3) + v["g"] % 8))))
    place = lambda v, i: F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int")
    again = F.transform(bound, lambda v: F.array_join(F.transform(v["w"], lambda _, i: F.get(v["w"], place(v, i))), " "))
    return F.when((seed % 10 == 0) & F.coalesce(F.length(F.regexp_replace(text, SPACE, "")) > 0, F.lit(False)), F.get(again, F.lit(0))).otherwise(text)

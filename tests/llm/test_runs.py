"""Periodic runs against a plain search over all starts and periods."""

import hashlib
import random
import time
import zlib

import pytest
from conftest_llm import plain

from ridgeline.llm import runs
from ridgeline.llm.queries import runs_report


def by_force(words, least=12):
    """All runs: for each period the longest stretches, without those that a smaller period explains."""
    n, out = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_plain_search(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.6 and words:
            a, p = rng.randrange(len(words)), rng.randint(1, 12)
            words = words[:a] + [words[a + (i - a) % min(p, len(words) - a)] for i in range(a, len(words))]
        for least in (2, 12):
            assert runs.runs_of(runs.numbered([str(w).encode() for w in words]), least) == by_force(words, least)


def test_fibonacci_words():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    assert runs.runs_of([ord(c) for c in b], 12) == by_force(b)


def test_a_hash_that_always_agrees_changes_nothing(monkeypatch):
    monkeypatch.setattr(runs.Stretches, "_same", lambda *_: True)
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 60))]
        assert runs.runs_of(words, 2) == by_force(words, 2)


@pytest.mark.parametrize("text", ["a " * 300_000, "a b c d e f g h " * 40_000, " ".join(str(i * i % 1013) for i in range(300_000)), ("x " * 50 + "y ") * 6_000])
def test_long_texts_take_no_square_of_time(text):
    start = time.perf_counter()
    found = runs.runs_of(runs.numbered(text.encode().split()))
    assert found and time.perf_counter() - start < 25


def report(doc_id, text):
    words = (text or "").encode().split()
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_force(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    start, length, period = best or (None,) * 3
    return {"doc_id": doc_id, "n_runs": len(found), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if best else None, "runs_sha256": sha(listed.encode()), "collapsed_sha256": sha(b" ".join(w for k, w in enumerate(words) if k not in gone))}


def test_report_equals_plain_version(corpus, odd):
    for df in (corpus, odd):
        want = sorted((report(r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, str(r)))
        got = plain(runs_report(df))
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(r["n_runs"] for r in got) or any(r["n_runs"] for r in plain(runs_report(corpus)))


def test_no_rows(empty):
    assert runs.periodic_runs(empty).collect() == [] and runs_report(empty).collect() == []


def test_collapsed_text_and_odd_spaces(spark):
    text = "q \t w " + "e r " * 8 + "t\x0by\x0c\x0d\n z\x1cz z"
    row = runs.periodic_runs(spark.createDataFrame([(1, text), (2, " \n")], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in row[0]["runs"]] == [(2, 16, 2)]
    assert row[0]["collapsed"] == "q w e r t y z\x1cz z" and row[1]["collapsed"] == "" and row[1]["runs"] == []

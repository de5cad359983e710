"""Decontamination against a plain search of all windows, and the automaton against plain substring sets."""

import hashlib
import random
import re

import pytest
from conftest_llm import plain

from ridgeline.llm import decontaminate as d
from ridgeline.llm.queries import contamination_report


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_force(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append({"doc_id": doc, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), "contaminated": bool(hit)})
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcd") + rng.choice(["", "x", "é", "7"])
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 40, 90]) if i % 4 else 25)) for i in range(60)]
    items += [(3, text(30)), (None, text(14)), (100, None), (101, " !? "), (102, items[7][1]), (103, "ÀÉ zz zz zz zz zz zz zz zz zz zz zz zz")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(80)]
    for i in range(40):
        mine = rng.choice(items)[1] or ""
        cut = mine[rng.randint(0, 8) :]
        docs.append((100 + i, text(rng.randint(0, 20)) + " " + cut.upper().replace("É", "é") + " " + text(9)))
    docs += [(None, items[0][1]), (None, None), (5, docs[5][1]), (1, ""), (2, "zz " * 30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans", "'q' as items", "2 as row").repartition(5)
    return docs, items, frame, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as block")


def test_equals_plain_search(tables):
    docs, items, frame, bench = tables
    got = plain(contamination_report(frame, bench))
    assert sorted(map(str, got)) == sorted(map(str, by_force(docs, items)))
    assert sum(r["contaminated"] for r in got) > 40


def test_many_blocks_and_cut_items_give_the_same(tables, monkeypatch):
    docs, items, frame, bench = tables
    cut = d.blocks
    monkeypatch.setattr(d, "blocks", lambda i, w, a, b, n: cut(i, w, a, b, n, piece_words=15))
    got = d.contamination(frame, bench, block_words=120).selectExpr("doc_id", "n_words", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as n_hit", "array_join(items, ',') as items")
    want = d.contamination(frame, bench).selectExpr("doc_id", "n_words", "aggregate(spans, 0L, (n, s) -> n + s.end - s.start) as n_hit", "array_join(items, ',') as items")
    assert cut(bench, 10, "item_id", "text", 120, 15).count() > 4
    assert sorted(map(str, plain(got))) == sorted(map(str, plain(want)))


def test_automaton_knows_all_substrings():
    rng = random.Random(1)
    for _ in range(50):
        rows = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(5)]
        made = d.Builder()
        for r in rows:
            made.add(r)
        inside = {tuple(r[i:j]) for r in rows for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        assert sum(made.length[s] - made.length[made.link[s]] for s in range(1, len(made.length))) == len(inside)
        for r in inside:
            *_, state = made.prefix_states(list(r))
            held = made.holder(state, len(r))
            assert made.length[made.link[held]] < len(r) <= made.length[held]


def test_cuts_spans_and_limits(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before: {item.title()}! After, x y z a b c d"), (2, item), (3, None), (4, "two three"), (5, item + " . ONE two three four five six seven eight nine ten")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in d.decontaminate(docs, bench, coverage=0.9).collect()}
    assert rows[1]["text"] == "Before: ! After, x y z a b c d" and rows[1]["kept"]
    assert rows[2]["text"] == "" and not rows[2]["kept"]
    assert rows[3]["text"] == "" and rows[3]["kept"] and rows[4]["text"] == "two three"
    assert rows[5]["text"] == "" and not rows[5]["kept"]
    whole = {r["doc_id"]: r["text"] for r in d.decontaminate(docs, bench, longest=11).collect()}
    assert whole[2] == item and whole[5] == ""


def test_no_rows_no_items(spark, empty, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contamination(empty, none).collect() == []
    rows = d.contamination(odd, none).collect()
    assert len(rows) == odd.count() and all(r["spans"] == [] and r["items"] == [] for r in rows)
    assert d.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []


def test_very_long_text(spark):
    text = "w q " * 400_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = d.contamination(docs, spark.createDataFrame([("i", "w q " * 6), ("j", "q")], "item_id string, text string")).collect()[0]
    assert row["n_words"] == 800_000 and [tuple(s) for s in row["spans"]] == [(0, 800_000)] and row["items"] == ["i", "j"]

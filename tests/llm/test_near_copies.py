"""The pipeline's near dedup against brute force over all pairs."""

import random

import pytest
from conftest_llm import SCHEMA, plain

import corpus_pipeline as pipeline
from ridgeline.llm.near_copies import drop_near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(texts):
    """Least id of each component under links of Jaccard similarity 0.8 or more."""
    sets, root = {d: plain_shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted({top(d) for d in ids})


@pytest.fixture(scope="module")
def edited(spark):
    """Texts of 60 to 200 words, each with copies of 0 to 5 words changed, and chains of such edits."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    texts = []
    for _ in range(40):
        text = rng.choices(words, k=rng.randint(60, 200))
        for _ in range(6):
            texts.append(" ".join(text))
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3).persist()


def test_stage_links_at_four_fifths(spark, edited):
    texts = {r["doc_id"]: r["text"] for r in edited.collect()}
    kept = plain(pipeline.near_dedup(spark, edited, ""))
    assert [r["doc_id"] for r in kept] == plain_kept(texts) and all(r["text"] == texts[r["doc_id"]] for r in kept)


@pytest.mark.parametrize("common", [{}, {"sampled": 1, "common": 2}])
def test_near_copies(corpus, common):
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert [r["doc_id"] for r in plain(drop_near_copies(corpus, **common))] == plain_kept(texts)


def test_odd_rows(spark, odd, empty):
    assert drop_near_copies(empty).collect() == []
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, "alone here"), (1, "one two three four five"), (2, "")]

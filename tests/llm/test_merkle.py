"""The manifest against a plain tree of lists, and a manifest's tables on disk."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import merkle
from ridgeline.llm.queries import manifest_report

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def reduced(nodes):
    """Levels of a tree, the nodes first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, at):
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        yield run, at % 8
        at //= 8


def by_force(rows):
    first = lambda v, least: (v is not None, least if v is None else v)
    rows = sorted(({**r, "leaf": leaf_of(r)} for r in rows), key=lambda r: (first((r["lang"] or "").encode() if r["lang"] is not None else None, b""), first(r["doc_id"], 0), r["leaf"]))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: (r["lang"] is not None, r["lang"]))]
    trees = [reduced([r["leaf"] for r in g]) for g in groups]
    top = reduced([t[-1][0] for t in trees])
    out = []
    for k, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for at, r in enumerate(group):
            now = dict(r)
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                now["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
            folded, siblings = leaf_of(now), ""
            for run, place in [*path(tree, at), *path(top, k)]:
                siblings += "".join(d for i, d in enumerate(run) if i != place)
                folded = h("".join(folded if i == place else d for i, d in enumerate(run)))
            out.append((r["doc_id"], r["leaf"], tree[-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def documents(spark, sizes, extra=()):
    rng = random.Random(2)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["The End", "all small", None, "", "ÄÖ É A\U0001f642", "x" * 3000])
            rows.append((rng.randrange(-10**6, 10**12), text, lang, rng.choice(["web", None, "a:b"]), rng.choice([None, 7])))
    rng.shuffle(rows)
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"id": F.lit(1), "leaf": F.lit("x"), "group": F.lit(None).cast("int"), "number": F.lit(2)})


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 64, None: 9, "fr": 1, "É": 8, "": 65, "zz": 2}, {"en": 1}, {None: 513}, {f"l{i}": 1 + i % 3 for i in range(80)}])
def test_equals_plain_tree(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "VERTICES", 100)  # several ranges and partitions
    df = documents(spark, sizes, [(None, "A", next(iter(sizes)), None, 1), (5, "Twice", next(iter(sizes)), "s", 1), (5, "Twice", next(iter(sizes)), "s", 1), (5, "other", next(iter(sizes)), "s", 1)])
    want = by_force([r.asDict() for r in df.collect()])
    got = sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest_report(df).collect()), key=str)
    assert got == want
    assert any(r[-1] for r in got) and (len(got) < 9 or not all(r[-1] for r in got))


def test_no_rows(spark, empty):
    made = merkle.build(empty)
    assert made.root is None and merkle.proofs(made).collect() == [] and manifest_report(empty).collect() == []


def test_saved_manifest_and_other_keys(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i % 3, "t" * i) for i in range(40)], "name string, part int, body string")
    made = merkle.build(df, group="part", id_col="name", fields=["name", "body"])
    made.save(str(tmp_path / "m"))
    kept = spark.read.parquet(str(tmp_path / "m/vertices"))
    assert {(r["tree"], r["level"]) for r in kept.select("tree", "level").distinct().collect()} == {("groups", 1), ("groups", 2), ("top", 1)}
    assert kept.where("tree = 'top'").first()["digest"] == made.root
    assert spark.read.parquet(str(tmp_path / "m/leaves")).count() == 40
    assert merkle.proofs(made).where("verified").count() == 40


def test_any_change_breaks_the_proof(spark):
    df = spark.createDataFrame([(i, "l", f"text {i}") for i in range(100)], "doc_id long, lang string, text string")
    other = merkle.leaf(F.col("doc_id"), F.when(F.col("doc_id") == 17, "text 17 ").otherwise(F.col("text")))
    rows = merkle.proofs(merkle.build(df, fields=["doc_id", "text"], seen=other)).where("not verified").collect()
    assert [r["id"] for r in rows] == [17]

"""Near copies by SimHash and the exact Jaccard similarity of word shingles, for the pipeline.

Fingerprints of the sets of shingles link by the binary trie self-join of `simhash`. At a Jaccard similarity of 4 / 5
fingerprints may differ in ten bits and more, which no bit budget that prunes reaches. So a prefix join finds the rest:
sets in one global order of shingles, common ones last, can only reach the similarity if their prefixes share enough
shingles. Of the holders of its shingles, each set's most frequent neighbour by size is met along with SimHash's links;
then only pairs that these leave in different components are. Every link is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import components, discard, marked, written
from ridgeline.llm.simhash import fingerprint_links, majority

SHINGLE = 5
#: Least similarity of a link, as a fraction: 4 / 5.
PART, WHOLE = 4, 5
#: One in so many documents is counted to tell common shingles, and the least count there of a common one.
SAMPLED, COMMON = 8, 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words is one shingle, so is one without any."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 7)], np.uint64)
    own = np.fromiter((digest(w, 42) for w in words), np.uint64, len(words))
    n = len(words) - shingle + 1
    out = np.zeros(n, np.uint64)
    for k in range(shingle):
        out = _mixed(out * _STEP + own[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def _common(rows: DataFrame, text: str, shingle: int, sampled: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their counts in the sample; at most 100,000."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                found = [shingles(t, shingle) for t in b[text].iloc[at : at + 256]]
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"key": keys.view(np.int64), "n": counts})

    part = rows.where(F.pmod(F.xxhash64(text), F.lit(sampled)) == 0).select(text)
    # Copies of one text count once: they are one set later.
    counts = part.distinct().mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    since = marked()
    counts = written(counts, "near-common")  # so the shuffle files of all sampled shingles go at once
    top = counts.orderBy(F.desc("n"), "key").limit(100_000).collect()
    discard(rows.sparkSession, since)
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] for r in top], np.int64)[order]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prefix(n: int) -> int:
    """Length of the prefix of a set of n, of which two similar sets must share a shingle."""
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def _sizes(a: str, b: str) -> str:
    """Condition: sets of sizes a and b can reach the similarity at all."""
    return f"{WHOLE} * least({a}, {b}) >= {PART} * greatest({a}, {b})"


def _reach(a: str, b: str, both: str) -> str:
    """Condition: sets of sizes a and b whose prefixes share `both` shingles can reach it if one has all its rest shared."""
    rest = "greatest(" + ", ".join(f"(({PART} * {x} + {WHOLE - 1}) div {WHOLE} - 1)" for x in (a, b)) + ")"
    return f"{PART + WHOLE} * ({both} + {rest}) >= {PART} * ({a} + {b})"


def _links(reps: DataFrame, held_of) -> DataFrame:
    """(u, v): verified links that span every component of reps (fp, sim, n, prefix)."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out.append((PART + WHOLE) * len(np.intersect1d(x, y, assume_unique=True)) >= PART * (len(x) + len(y)))
        return pd.Series(out, dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        since = marked()
        pairs = written(pairs, "near-tried")
        held = written(held_of(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()), "near-sets")
        both = pairs.join(held.select(F.col("fp").alias("u"), F.col("grams").alias("x")), "u").join(held.select(F.col("fp").alias("v"), F.col("grams").alias("y")), "v")
        links = written(both.where(alike("x", "y")).select("u", "v"), "near-links")
        discard(reps.sparkSession, since, [links])  # the whole sets are only needed here
        return links

    # Sets of one fingerprint meet one of them; the fingerprints' own links join these.
    sims = written(reps.groupBy("sim").agg(F.min("fp").alias("rep")), "near-sims")
    apart = fingerprint_links(sims.select(F.col("sim").alias("fp")), sims.count())
    rep = lambda side: sims.select(F.col("sim").alias(side), F.col("rep").alias(f"rep_{side}"))
    across = apart.join(rep("u"), "u").join(rep("v"), "v").select("rep_u", "rep_v")
    like = reps.join(sims, "sim").where("fp <> rep").select("fp", "rep").union(across).toDF("u", "v")

    dealt = reps.select("fp", "n", F.explode("prefix").alias("key"))
    w = Window.partitionBy("key").orderBy("n", "fp")
    near = dealt.withColumns({"before": F.lag(F.struct("fp", "n")).over(w), "after": F.lead("fp").over(w)})
    shared = written(near.where("before is not null or after is not null").select("key", "fp", "n", "before"), "near-shared")
    often = shared.where("before is not null").where(_sizes("n", "before.n")).groupBy("fp", "before").agg(F.count("*").alias("times"))
    often = often.groupBy("fp").agg(F.max_by("before.fp", F.struct("times", "before.fp")).alias("v")).select(F.col("fp").alias("u"), "v")

    pairs = like.unionByName(often).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    first = written(pairs.distinct(), "near-pairs")
    links = verified(first)
    roots = components(links).withColumnRenamed("node", "fp")
    placed = shared.drop("before").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Shingles whose holders are one component already need no pair.
    many = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = written(placed.join(many, "key", "left_semi"), "near-open")
    # Prefixes of sets in different components share just the shingles that stand here.
    met = open_.alias("a").join(open_.alias("b"), "key").where("a.fp < b.fp and a.root <> b.root").where(_sizes("a.n", "b.n"))
    met = met.groupBy(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), F.col("a.n").alias("m"), F.col("b.n").alias("n")).agg(F.count("*").alias("both"))
    rest = met.where(_reach("m", "n", "both")).select("u", "v").join(first, ["u", "v"], "left_anti")
    return links.unionByName(verified(rest))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, sampled: int = SAMPLED, common: int = COMMON) -> DataFrame:
    """One row of df for each component under links of Jaccard similarity 4 / 5 or more of word shingles: that of the
    smallest id, null ids last; of rows that repeat this id a single one.

    Texts without a word, null ones too, are alike. All columns stay as they are. Empty table: no rows.
    """
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*(F.col(f"`{c}`").alias(v) for c, v in names.items()))
    text = names[text_col]
    sent = df.sparkSession.sparkContext.broadcast(_common(rows, text, shingle, sampled, common))

    @F.pandas_udf("fp long, sim long, n int, prefix array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        keys, counts = sent.value
        out = []
        for t in texts:
            grams = shingles(t, shingle)
            n = len(grams)
            fp = xxhash.xxh64_intdigest(grams.tobytes(), n)
            ordered = grams
            if len(keys):
                at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                ordered = grams[np.argsort(np.where(keys[at] == grams, counts[at], 0), kind="stable")]
            prefix = ordered[: _prefix(n)]
            out.append((signed(fp), signed(majority(grams)), n, prefix.view(np.int64)))
        return pd.DataFrame(out, columns=["fp", "sim", "n", "prefix"])

    @F.pandas_udf("binary")
    def grams_of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).tobytes() for t in texts], dtype=object)

    # A row is told by hashes of its id and text: no table holds the texts once more. Rows alike in both are one.
    own = [F.xxhash64(F.col(names[id_col]), F.col(text)).alias("k1"), F.hash(F.col(names[id_col]), F.col(text)).alias("k2")]
    sets = rows.select(F.col(names[id_col]).alias("id"), *own, described(F.col(text)).alias("set")).select("id", "k1", "k2", "set.*")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("best")
    since = marked()
    fps = written(written(sets, "near-input").groupBy("fp").agg(best, F.first(F.struct("sim", "n", "prefix")).alias("set")), "near-distinct")
    discard(df.sparkSession, since, [fps])

    def of(which: DataFrame, *columns: str) -> DataFrame:
        """The rows of `which` (k1, k2), once each, with their columns."""
        return rows.select("*", *own).join(which, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select(*columns)

    def held_of(wanted: DataFrame) -> DataFrame:
        return of(fps.join(wanted, "fp").select("fp", "best.k1", "best.k2"), "fp", text).select("fp", grams_of(F.col(text)).alias("grams"))

    since = marked()
    roots = written(components(_links(fps.select("fp", "set.*"), held_of)), "near-roots").withColumnRenamed("node", "fp")
    discard(df.sparkSession, since, [roots])
    whole = fps.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    stay = written(whole.select("best.k1", "best.k2"), "near-kept")
    return of(stay, *names.values()).toDF(*names)

"""Line dedup by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words (runs without white space). Words are ordered by rarity: a table of fixed size holds the
corpus count of each hash bucket of words, on a logarithmic scale. Lines with equal sets collapse into one
row before anything is compared; rows are numbered in the order of their first lines. Two sets of Jaccard >= 4/5 share
a word among the first few of each in the rarity order (prefix filter); pairs that do are kept if their sizes (length
filter) and the places of the shared word (positional filter) and 64-bit parity sketches allow the threshold, and are
then verified on 64-bit hashes of all their words.

A set needs one earlier match only. So the members of a group of near copies first meet two earlier sets that have two
neighbours of their four least word hashes in common with them; the prefix join lists pairs for the sets that this leaves alone.
Those whose heads all fail the verification meet the whole group, once a pair. Other members cost a few rows each.

Sets of less than four words have no similar ones. One of four is similar to those of five that hold it, and to no other;
a set of five is looked up by each four of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import discard, few, marked, written

BUCKETS = 1 << 18  # entries of the rarity table (8 bytes each), whatever the input
HASH_BITS = 56
LEAST = 4  # least word hashes of a set, of which near copies share two neighbours
LONG = 64  # words of a set from which its sketch has 128 bits
OF_SET = ("id", "n", "sketch", "half")  # what the filters look at
HEAD, BEFORE = 32, 16  # first words of a prefix that are counted, words before a shared one that tell whether two sets have met
FEW = 20_000  # sets that are broadcast when left over; more are shuffled
FEW_IDS = 500_000  # ids of 8 bytes that are broadcast


def spaced(text: Column) -> Column:
    """Text whose white space is spaces and line feeds alone."""
    others = "\t\x0b\x0c\r"
    found = F.lit(False)
    for c in others:
        found = found | F.contains(text, F.lit(c))
    return F.when(found, F.translate(text, others, " " * len(others))).otherwise(text)


def _hashes(line: Column) -> Column:
    """64-bit hashes of the distinct words of a line."""
    found = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    gaps = F.contains(F.concat(F.lit(" "), line, F.lit(" ")), F.lit("  "))  # else no word is empty
    return F.when(gaps, F.array_remove(found, F.xxhash64(F.lit("")))).otherwise(found)


def _ceil(times: int, n: Column, by: int) -> Column:
    return F.floor((n * times + (by - 1)) / by).cast("int")


def rarity_table(texts: DataFrame) -> DataFrame:
    """One row, one array of BUCKETS longs: how common the words of each hash bucket are over all texts, in the top byte."""
    spark = texts.sparkSession
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")
    words = texts.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.select(bucket).groupBy("bucket").agg(F.count("*").alias("n"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    level = F.least(F.lit(120), F.floor(F.log2(F.sum("n") + 1) * 4)).cast("long")
    levels = counts.unionByName(every).groupBy("bucket").agg(F.shiftleft(level, HASH_BITS).alias("level"))
    in_order = F.array_sort(F.collect_list(F.struct("bucket", "level")))
    return levels.agg(F.transform(in_order, lambda x: x["level"]).alias("table"))


def _codes(hashes: Column, table: Column) -> Column:
    """Sorted codes of words: rarity in the top byte, the word's hash in the other 56 bits."""

    def code(h: Column) -> Column:
        level = F.coalesce(F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))  # never null, so numbers are sorted as such
        return level.bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    return F.sort_array(F.transform(hashes, code))


def line_sets(texts: DataFrame) -> DataFrame:
    """One row per distinct set of words: id, n, its first line (doc, line_no), copies, its least hashes, sketch, prefix and kin.

    texts: doc, text. Ids follow the order of first lines. Sets are told apart by 96 bits of hashes of all their codes.
    The prefix holds 31 bits of each code; a sketch bit is the parity of the number of words whose hash falls on it; kin
    are the keys of a set of four words and of the fours of a set of five.
    """
    texts = texts.select("doc", spaced(F.col("text")).alias("text"))
    table = rarity_table(texts)
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hashed = lines.select("doc", "line_no", _hashes(F.col("line")).alias("hashes"))
    least = F.transform(F.slice(F.sort_array("hashes"), 1, LEAST), lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    # The table comes in where hashes are used twice: projections then meet such that it is never copied into a row.
    coded = hashed.select("doc", "line_no", least.alias("least"), "hashes", table.scalar().alias("table")).select("doc", "line_no", "least", _codes(F.col("hashes"), F.col("table")).alias("codes"))
    n = F.size("codes")
    prefix = F.transform(F.slice("codes", 1, F.when(n > 4, n - _ceil(4, n, 5) + 1).otherwise(0)), lambda c: c.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    odd = lambda codes: F.aggregate(codes, F.lit(0).cast("long"), lambda seen, c: seen.bitwiseXOR(bit(c)))
    half = F.when(n > LONG, odd(F.filter("codes", lambda c: c.bitwiseAND(F.lit(64)) != 0))).otherwise(F.lit(0).cast("long"))
    whole = F.aggregate("codes", F.lit(0).cast("long"), lambda seen, c: seen.bitwiseXOR(c))
    kin = F.when(n == 5, F.transform("codes", lambda c: whole.bitwiseXOR(c))).when(n == 4, F.array(whole))
    first = F.struct("doc", "line_no", n.alias("n"), "least", odd("codes").alias("sketch"), half.alias("half"), prefix.alias("prefix"), kin.alias("kin")).alias("s")
    keyed = coded.select(F.xxhash64("codes").alias("k1"), F.hash("codes").alias("k2"), first)
    sets = keyed.groupBy("k1", "k2").agg(F.min("s").alias("s"), F.count("*").cast("int").alias("copies"))
    # Not where the prefixes meet: a lambda there would make two shuffles of what is one.
    bits = F.aggregate("prefix", F.lit(0).cast("long"), lambda seen, c: seen.bitwiseOR(bit(c)))
    return sets.select("s.*", "copies").where("n > 0").withColumn("bits", bits).orderBy("doc", "line_no").withColumn("id", F.monotonically_increasing_id())


def _may_match(a: str, b: str) -> Column:
    """Whether sets with these suffixes of column names can reach the threshold by sizes and sketches.

    Words of one set only are at most a ninth of both sizes together; each odd one out sets one bit at most. The sketches
    of two long sets are taken in their two halves, 128 bits in all.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    whole = F.col(f"sketch_{a}").bitwiseXOR(F.col(f"sketch_{b}"))
    half = F.col(f"half_{a}").bitwiseXOR(F.col(f"half_{b}"))
    apart = F.when((n_a > LONG) & (n_b > LONG), F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))
    return (n_a * 5 >= n_b * 4) & (n_b * 5 >= n_a * 4) & (apart * 9 <= n_a + n_b)


def heads_met(sets: DataFrame) -> DataFrame:
    """(later, earlier): for each set the earlier ones that it meets and that their sketches leave, six at most.

    Sets with two neighbours among their least hashes in common meet the earliest of them and the one with most copies.
    """
    word = lambda i: F.get("least", i).cast("long")
    pairs = F.array(*(F.shiftleft(word(i), 31).bitwiseOR(word(i + 1)) for i in range(LEAST - 1)))
    most = F.shiftleft(F.least("copies", F.lit(127)).cast("long"), 56) - F.col("id")  # by copies, then the earliest
    keyed = sets.where("n > 4").select(*OF_SET, most.alias("most"), F.explode(pairs).alias("key"))
    # Numbers alone, so that groups are hashed and not sorted.
    met = [f(c, by).alias(f"{c}_{by}") for f, by in ((F.min_by, "id"), (F.max_by, "most")) for c in OF_SET]
    groups = keyed.groupBy("key").agg(*met, F.count("*").alias("all")).where("all > 1")
    of = lambda by: F.struct(*(F.col(f"{c}_{by}").alias(c) for c in OF_SET))
    heads = written(groups.select("key", F.array_distinct(F.array(of("id"), of("most"))).alias("met")), "line-heads")
    both = keyed.select(F.struct(*OF_SET).alias("a"), "key").join(heads, "key").select("a", F.explode("met").alias("b")).where("b.id < a.id")
    both = both.select(*(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in OF_SET))
    return both.where(_may_match("a", "b")).select(F.col("id_a").alias("later"), F.col("id_b").alias("earlier")).distinct()


def fours_met(sets: DataFrame) -> DataFrame:
    """(later, earlier) of each set of four words and each set of five that holds them; five rows for a set of five at most."""
    of = lambda n: sets.where(F.col("n") == n).select(F.explode("kin").alias("key"), F.col("id").alias(f"of_{n}"))
    met = of(4).join(of(5), "key")
    return met.select(F.greatest("of_4", "of_5").alias("later"), F.least("of_4", "of_5").alias("earlier"))


def candidate_rows(later: DataFrame, sets: DataFrame) -> DataFrame:
    """(later, earlier), few times a pair: the sets of `later` whose upto isn't below their id with those of lower ids that
    the prefix, length and positional filters and the sketches leave. Both have the columns of sets and `upto`.

    Prefixes that two similar sets share by `both` words end in one of them with both in all; what the other may add is
    its rest, so pairs with too few words shared in their prefixes fall too. `both` is bounded by the bits on which the
    words of both prefixes fall, and by the words of a prefix that share a bit.

    Near copies share most words of their prefixes. A row is left out where one of the two words before the shared one
    is the same in both: the pair has met there. So a pair is listed for its first shared word and after gaps.
    """
    before = lambda i: F.coalesce(F.get("prefix", F.col("at") - i), F.lit(0)).cast("long")
    # Places are below 0 for sets that list nothing, so the same frame on both sides is shuffled once.
    place = F.when(F.col("upto") < F.col("id"), -1 - F.col("at")).otherwise(F.col("at"))
    row = {c: F.col(c) for c in (*OF_SET, "bits")} | {"at": place, "seen": F.shiftleft(before(1), 31).bitwiseOR(before(2))}

    def at(of: DataFrame, side: str) -> DataFrame:
        one = of.where("n > 4 and id is not null").select(*OF_SET, "upto", "prefix", "bits")  # as the join asks of one side
        return one.select("*", F.posexplode("prefix").alias("at", "code")).select("code", *(v.alias(f"{c}_{side}") for c, v in row.items()))

    n_a, n_b = F.col("n_a"), F.col("n_b")
    words = lambda n: n - _ceil(4, n, 5) + 1
    both = F.bit_count(F.col("bits_a").bitwiseAND(F.col("bits_b"))) + F.least(words(n_a) - F.bit_count("bits_a"), words(n_b) - F.bit_count("bits_b"))
    rest = F.greatest(_ceil(4, n_a, 5), _ceil(4, n_b, 5)) - 1
    # At the first shared word of a pair, which is always listed, none before it is shared.
    most = F.least(both + rest, n_a - F.col("at_a"), n_b - F.greatest(F.col("at_b"), -1 - F.col("at_b")))
    word = lambda s, i: F.shiftright(f"seen_{s}", 31) if i == 1 else F.col(f"seen_{s}").bitwiseAND(F.lit(0x7FFFFFFF))
    met = F.lit(False)
    for i in (1, 2):
        met = met | (word("a", i) > 0) & ((word("a", i) == word("b", 1)) | (word("a", i) == word("b", 2)))
    # A condition on both sides: one on at_a alone would be moved below the shuffle of that side, which then would differ.
    earlier = F.col("id_b") < F.when(F.col("at_a") >= 0, F.col("id_a")).otherwise(-1)
    found = at(later, "a").join(at(sets, "b"), "code").where(earlier & _may_match("a", "b") & (most * 9 >= (n_a + n_b) * 4) & ~met)
    return found.select(F.col("id_a").alias("later"), F.col("id_b").alias("earlier"))


def candidate_pairs(later: DataFrame, sets: DataFrame) -> DataFrame:
    """(later, earlier) of candidate_rows, each pair once."""
    return candidate_rows(later, sets).distinct()


def left_over_pairs(later: DataFrame, sets: DataFrame) -> DataFrame:
    """(later, earlier): the sets of `later`, which has the columns of sets, with the earlier ones of `sets` that the
    prefix and length filters and the sketches leave; almost always once a pair.

    Near copies share most words of their prefixes. They meet at the first of them and are not listed again where
    the BEFORE words before it, in both, have one in common: the join makes a row a pair and not one a shared word.
    """

    def at(of: DataFrame, side: str) -> DataFrame:
        placed = of.where("n > 4").select(*OF_SET, "prefix", F.posexplode("prefix").alias("at", "code"))
        seen = F.slice("prefix", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
        return placed.select("code", *(F.col(c).alias(f"{c}_{side}") for c in (*OF_SET, "at")), F.slice("prefix", 1, HEAD).alias(f"head_{side}"), seen.alias(f"seen_{side}"))

    n_a, n_b = F.col("n_a"), F.col("n_b")
    beyond = lambda n: F.greatest(n - _ceil(4, n, 5) + 1 - HEAD, F.lit(0))
    # Words shared by the prefixes, or more where words have equal codes or lie beyond the heads; see candidate_pairs().
    shared = F.size("head_a") - F.size(F.array_except("head_a", "head_b")) + beyond(n_a) + beyond(n_b)
    rest = F.greatest(_ceil(4, n_a, 5), _ceil(4, n_b, 5)) - 1
    met = at(later, "a").join(at(sets, "b"), "code").where((F.col("id_b") < F.col("id_a")) & _may_match("a", "b") & ~F.arrays_overlap("seen_a", "seen_b") & ((shared + rest) * 9 >= (n_a + n_b) * 4))
    return met.select(F.col("id_a").alias("later"), F.col("id_b").alias("earlier"), "n_a", "n_b", "at_a", "at_b")


def once(met: DataFrame) -> DataFrame:
    """(later, earlier) of left_over_pairs, each once, if what follows the first shared word of both is enough."""
    pairs = met.groupBy("later", "earlier").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    first = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    return pairs.where(first * 9 >= (F.col("n_a") + F.col("n_b")) * 4).select("later", "earlier")


def line_words(asked: DataFrame, docs: DataFrame, left_over: bool) -> DataFrame:
    """(id, words): the hashes of the words of each set of `asked` (id, doc, line_no), a written table; left_over: it may
    be small enough to be broadcast."""
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("line_no", "id")).alias("asked"))
    found = docs.join(few(by_doc, asked, 5 * FEW) if left_over else by_doc, "doc").select(F.split(spaced(F.col("text")), "\n").alias("lines"), F.explode("asked").alias("x"))
    lines = found.select(F.col("x.id").alias("id"), _hashes(F.get("lines", F.col("x.line_no"))).alias("words"))
    return lines.groupBy("id").agg(F.first("words").alias("words"))  # one row where documents repeat


def matches(pairs: DataFrame, sets: DataFrame, docs: DataFrame, left_over: bool = False) -> DataFrame:
    """The rows of pairs (later, earlier) whose sets have Jaccard >= 4/5."""
    ids = pairs.select(F.col("later").alias("id")).distinct().unionByName(pairs.select(F.col("earlier").alias("id")).distinct()).distinct()
    asked = ids.join(sets.select("id", "doc", "line_no"), "id")
    words = written(line_words(written(asked, "line-asked"), docs, left_over), "line-words")
    of = lambda side: words.select(F.col("id").alias(side), F.col("words").alias(f"{side}_words"))
    both = pairs.join(of("earlier"), "earlier").join(of("later"), "later")
    return both.where(F.size(F.array_intersect("later_words", "earlier_words")) * 9 >= (F.size("later_words") + F.size("earlier_words")) * 4).select("later", "earlier")


def repeated_sets(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """id of each set whose Jaccard with an earlier, different set is >= 4/5. docs: doc, text."""
    near = written(heads_met(sets), "line-near")
    ids = near.select(F.col("later").alias("id")).distinct()
    # Both sides of the join are the same rows, shuffled once: a set that met a head has no id below its upto.
    known = sets.drop("doc", "line_no", "least", "copies", "kin").join(few(ids.withColumn("upto", F.lit(-1).cast("long")), near, FEW_IDS), "id", "left").withColumn("upto", F.coalesce("upto", "id"))
    pairs = written(near.unionByName(candidate_pairs(known, known)).unionByName(fours_met(sets)), "line-pairs")
    settled = written(matches(pairs, sets, docs).select(F.col("later").alias("id")).distinct(), "line-settled")
    # Sets whose heads all failed have not met the others yet.
    failed = written(sets.join(ids, "id", "left_semi").join(settled, "id", "left_anti"), "line-failed")
    more = written(once(left_over_pairs(few(failed, failed, FEW), sets)), "line-more")
    return settled.unionByName(matches(more, sets, docs, left_over=True).select(F.col("later").alias("id")).distinct())


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """All columns and rows of df, text without its repeated lines, and with `counts` n_lines, n_removed (long).

    A line goes if its set of words has Jaccard >= 0.8 with that of any earlier line of the corpus; earlier is by id
    (null ids first), then by hash of the text where rows share an id, then by line; removed lines count as earlier
    ones too. Lines without words stay. A null text stays null with no lines; an empty one has one line. Rows that
    repeat an id and a text are one document: each of them keeps the same lines. Columns of df named n_lines or
    n_removed are replaced by the counts, without `counts` they stay. Empty table: no rows.
    """
    df = df.drop(*(c for c in ("n_lines", "n_removed") if counts and c not in (id_col, text_col)))
    extra = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    docs = df.select(*(F.col(f"`{c}`").alias(v) for c, v in extra.items()))
    docs = docs.withColumn("text", F.col(extra[text_col])).withColumn("doc", F.struct(F.col(extra[id_col]).alias("id"), F.xxhash64("text").alias("hash")))
    with_text = docs.select("doc", "text").where("text is not null")
    sets = written(line_sets(with_text), "line-sets")
    since = marked()
    gone = written(repeated_sets(sets, with_text), "line-gone")
    discard(df.sparkSession, since, [gone])
    kept = sets.select("id", "doc", "line_no").join(gone, "id", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list("line_no")).alias("_kept"))
    # The kept line numbers as one flag a line: false up to each, then true.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.col("_kept")[i - 1])
    flags = F.flatten(F.transform("_kept", lambda v, i: F.concat(F.array_repeat(F.lit(False), v - before(i) - 1), F.array(F.lit(True)))))
    joined = docs.drop(extra[text_col]).join(kept, "doc", "left").withColumn("_flags", flags).withColumn("_lines", F.split("text", "\n"))
    blank = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    done = joined.withColumn("_left", F.filter("_lines", lambda x, i: F.coalesce(F.get("_flags", i), F.lit(False)) | blank(x)))
    out = [(F.array_join("_left", "\n") if c == text_col else F.col(v)).alias(c) for c, v in extra.items()]
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    return done.select(*out, *([n("_lines").alias("n_lines"), (n("_lines") - n("_left")).alias("n_removed")] if counts else []))

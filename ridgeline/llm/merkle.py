"""Merkle manifest of a dataset: a tree of hashes for each group, built and verified in Pregel-style RDD supersteps.

Vertices are numbered in their group and level. Upward supersteps: each completed vertex sends its digest to its
parent, which completes when its run of children is there, hashes it and sends on; the only vertex that a group has
left is its subroot. The subroots form a tree of their own in the same way. Downward supersteps: each vertex sends its
children the digests of its run of children with what it got from above, so that every leaf ends with the siblings of
its whole path and folds them up to the root. A superstep is one shuffle by vertex; its result is a table in the shared
folder, which cuts the lineage.

Leaves are numbered by one sort into ranges and the sizes of the ranges, so a group may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ridgeline.llm.common import discard, marked, written

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
VERTICES = 20_000  # of a superstep in one partition, if there are partitions enough
HEX = 64


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8, a colon and itself, or '-' if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


@dataclass
class Tree:
    """Tables of a tree for each group. leaves: group, id, leaf, seen, number, last; vertices, lowest level first: group,
    number, last, digest, children, and at the lowest level ids and seen; subroots: group, digest."""

    leaves: DataFrame
    vertices: list[DataFrame]
    subroots: DataFrame


@dataclass
class Manifest:
    """The trees of the groups and the tree over their subroots, whose only subroot is the root (null without rows)."""

    groups: Tree
    top: Tree
    root: str | None

    def save(self, path: str) -> None:
        """Writes leaves, subroots and all vertices with their level (0: the top tree's count on) as Parquet."""
        self.groups.leaves.select("group", "number", "id", "leaf").write.parquet(f"{path}/leaves")
        self.groups.subroots.write.parquet(f"{path}/subroots")
        for name, tree in (("groups", self.groups), ("top", self.top)):
            for level, table in enumerate(tree.vertices, 1):
                table.select("group", "number", "digest", "children").write.parquet(f"{path}/vertices/tree={name}/level={level}")


def _place(key: tuple) -> int:
    """Where a vertex is: the same in every process."""
    return zlib.crc32(repr(key).encode())


def _parts(spark: SparkSession, vertices: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vertices // VERTICES)))


def _table(spark: SparkSession, rows: RDD, shape: StructType, name: str) -> DataFrame:
    return written(spark.createDataFrame(rows, shape, verifySchema=False), name)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (group, id, leaf, seen), sorted by these, with number and last in their group; a written table.

    Two passes over one sorted RDD, whose ranges are fixed: the first counts, the second numbers. From each range the
    driver gets its first and last group with their counts, since a group that others precede in its range begins there.
    """
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(_parts(spark, rows.count()), "group", "id", "leaf").sortWithinPartitions("group", "id", "leaf", "seen").rdd

    def ends(index: int, part: Iterator) -> Iterator[tuple]:
        first = last = None  # [group, rows]
        for r in part:
            if last is None:
                first = last = [r["group"], 0]
            elif r["group"] != last[0]:
                last = [r["group"], 0]
            last[1] += 1
        if last is not None:
            yield index, first, last, first is last

    held = sorted(ranges.mapPartitionsWithIndex(ends).collect())
    before, goes_on, run = {}, {}, (None, 0)
    for k, (index, first, last, alone) in enumerate(held):
        before[index] = run[1] if k and run[0] == first[0] else 0
        run = (last[0], last[1] + (before[index] if alone else 0))
        goes_on[index] = k + 1 < len(held) and held[k + 1][1][0] == last[0]

    def number(index: int, part: Iterator) -> Iterator[tuple]:
        ahead, at = next(part, None), before.get(index, 0)
        while ahead is not None:
            now, ahead = ahead, next(part, None)
            same = goes_on[index] if ahead is None else ahead["group"] == now["group"]
            yield (*now, at, not same)
            at = at + 1 if same else 0

    shape = StructType([*rows.schema.fields, StructField("number", LongType()), StructField("last", BooleanType())])
    return _table(spark, ranges.mapPartitionsWithIndex(number), shape, "leaves")


def _vertices(id_field: StructField) -> StructType:
    texts = ArrayType(StringType())
    return StructType([StructField("group", StringType()), StructField("number", LongType()), StructField("last", BooleanType()), StructField("digest", StringType()), StructField("children", texts), StructField("ids", ArrayType(id_field.dataType)), StructField("seen", texts)])


def grown(rows: DataFrame, fan_out: int = FAN_OUT) -> Tree:
    """The tree of each group of rows (group string, id, leaf string, seen string), by upward supersteps."""
    spark = rows.sparkSession
    leaves = _numbered(rows)
    shape, alone = _vertices(rows.schema["id"]), (F.col("number") == 0) & F.col("last")
    subroots = leaves.where(alone).select("group", F.col("leaf").alias("digest"))
    active = leaves.where(~alone).select("group", "number", "last", F.col("leaf").alias("digest"), "id", "seen")
    vertices: list[DataFrame] = []
    while (count := active.count()) > 0:

        def sent(r, lowest=not vertices):
            return (r["group"], r["number"] // fan_out), (r["number"] % fan_out, r["digest"], r["last"], *((r["id"], r["seen"]) if lowest else ()))

        def complete(found, lowest=not vertices):
            (group, number), run = found[0], sorted(found[1], key=lambda c: c[0])
            children = [c[1] for c in run]
            return (group, number, run[-1][2], digest("".join(children)), children, *(([c[3] for c in run], [c[4] for c in run]) if lowest else (None, None)))

        parents = active.rdd.map(sent).groupByKey(_parts(spark, count), _place).map(complete)
        vertices.append(_table(spark, parents, shape, "vertices"))
        subroots = subroots.unionByName(vertices[-1].where(alone).select("group", "digest"))
        active = vertices[-1].where(~alone)
    return Tree(leaves, vertices, subroots)


def build(df: DataFrame, group: str = "lang", id_col: str = "doc_id", fields: Iterable[str] = FIELDS, seen: Column | None = None, fan_out: int = FAN_OUT) -> Manifest:
    """The manifest of df: leaves are H of their fields, in each group by id.

    seen: the leaf as it is found later (a digest made of the same row), the leaf itself by default. Null groups are a
    group of their own, before all others; null ids come first; repeated ids are ordered by their leaves, so repeated
    rows stand side by side; no rows give no trees and no root. Columns that aren't fields, group or id are ignored.
    """
    made = leaf(*(F.col(f"`{c}`") for c in fields))
    rows = df.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{id_col}`").alias("id"), made.alias("leaf"), (made if seen is None else seen).alias("seen"))
    groups = grown(written(rows, "hashes"), fan_out)
    above = groups.subroots.select(F.lit(None).cast("string").alias("group"), F.col("group").alias("id"), F.col("digest").alias("leaf"), F.col("digest").alias("seen"))
    top = grown(above, fan_out)
    root = top.subroots.first()
    return Manifest(groups, top, root and root["digest"])


#: The messages of a downward superstep. path: for each level up to the root, from the vertex's children on, their
#: place in the run and the run's digests, as 'place:digests' joined by '|'.
MESSAGES = StructType([StructField("group", StringType()), StructField("number", LongType()), StructField("subroot", StringType()), StructField("path", StringType())])


def descended(tree: Tree, start: DataFrame, fan_out: int) -> DataFrame:
    """group, id, leaf, seen, subroot, path of each leaf, by downward supersteps; start: group, subroot and its path."""
    spark = start.sparkSession
    alone = (F.col("number") == 0) & F.col("last")
    starts = start.rdd.map(lambda r: ((r["group"], 0), ("start", r["subroot"], r["path"])))
    lone = tree.leaves.where(alone).select("group", "id", "leaf", "seen")
    leaves = lone.rdd.map(lambda r: ((r["group"], 0), ("leaf", r["group"], r["id"], r["leaf"], r["seen"])))
    below: DataFrame | None = None
    for level in range(len(tree.vertices) - 1, -1, -1):
        table = tree.vertices[level]
        held = table.rdd.map(lambda r: ((r["group"], r["number"]), ("vertex", r["last"], r["children"], r["ids"], r["seen"])))
        sent = held.union(starts)
        if below is not None:
            sent = sent.union(below.rdd.map(lambda r: ((r["group"], r["number"]), ("path", r["subroot"], r["path"]))))

        def passed(found, lowest=level == 0):
            (group, number), got = found[0], {m[0]: m[1:] for m in found[1]}
            if "vertex" not in got:  # a start whose group ends on another level
                return
            last, children, ids, seen = got["vertex"]
            subroot, path = got["start" if number == 0 and last else "path"]
            run = "".join(children)
            for k, child in enumerate(children):
                further = f"{k}:{run}" + (f"|{path}" if path else "")
                yield (group, ids[k], child, seen[k], subroot, further) if lowest else (group, number * fan_out + k, subroot, further)

        received = sent.groupByKey(_parts(spark, table.count()), _place).flatMap(passed)
        if level:
            below = _table(spark, received, MESSAGES, "messages")

    def own(found):
        got = {m[0]: m[1:] for m in found[1]}
        if "leaf" in got:
            yield (*got["leaf"], *got["start"])

    ended = leaves.union(starts).groupByKey(_parts(spark, lone.count()), _place).flatMap(own)
    shape = StructType([*lone.schema.fields, *MESSAGES.fields[2:]])
    return spark.createDataFrame(ended.union(received) if tree.vertices else ended, shape, verifySchema=False)


def levels(path: str) -> Iterator[tuple[list[str], int]]:
    """Each level's run of digests and the place in it, from the leaf up."""
    for part in path.split("|") if path else ():
        place, run = part.split(":")
        yield [run[i : i + HEX] for i in range(0, len(run), HEX)], int(place)


def siblings(path: str) -> str:
    return "".join(d for run, place in levels(path) for k, d in enumerate(run) if k != place)


def folded(now: str, path: str) -> str:
    """The root that follows from a leaf and the siblings of its path."""
    for run, place in levels(path):
        run[place] = now
        now = digest("".join(run))
    return now


def proofs(manifest: Manifest, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per leaf: group, id, leaf, seen, subroot, root, path (see MESSAGES), proof_sha256 (H of the siblings, level
    by level from the leaf up), folded_root (from `seen` and the siblings), verified (that is the root)."""
    spark = manifest.groups.leaves.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], StructType([*manifest.groups.leaves.schema.fields[:4], *(StructField(c, StringType()) for c in ("subroot", "root", "path", "proof_sha256", "folded_root")), StructField("verified", BooleanType())]))
    from_root = spark.createDataFrame([(None, manifest.root, "")], StructType([StructField(c, StringType()) for c in ("group", "subroot", "path")]))
    tops = descended(manifest.top, from_root, fan_out)
    starts = written(tops.select(F.col("id").alias("group"), F.col("leaf").alias("subroot"), "path"), "starts")
    rows, root = descended(manifest.groups, starts, fan_out), manifest.root

    def checked(r) -> tuple:
        now = folded(r["seen"], r["path"])
        return r["group"], r["id"], r["leaf"], r["seen"], r["subroot"], root, r["path"], digest(siblings(r["path"])), now, now == root

    text = [StructField(c, StringType()) for c in ("root", "path", "proof_sha256", "folded_root")]
    shape = StructType([*rows.schema.fields[:5], *text, StructField("verified", BooleanType())])
    return spark.createDataFrame(rows.rdd.map(checked), shape, verifySchema=False)


def verified_rows(df: DataFrame, seen: Column, **options) -> DataFrame:
    """What proofs() gives without group, seen and path, as a written table; the tree's own tables go."""
    since = marked()
    found = written(proofs(build(df, seen=seen, **options)).drop("group", "seen", "path"), "verified")
    discard(df.sparkSession, since, [found])
    return found

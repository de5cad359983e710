"""Matching entities, duplicate groups, keyed changes of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ridgeline.functions import geo
from ridgeline.operators.ranks import first_by


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where the session names none."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that driver and executors share, and read back; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def near_pairs(points: DataFrame, key: Sequence[str], metres: float, id_col: str = "complex_id") -> DataFrame:
    """(a, b), a < b: points of one key at most `metres` apart. Points meet only in neighbouring grid cells of that size."""
    step = metres / 111_000 * 1.01
    lng_step = step / 0.5  # holds up to 60 degrees of latitude
    cell = points.withColumns({"_y": F.floor(F.col("lat") / step), "_x": F.floor(F.col("lng") / lng_step)})
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    left = cell.withColumn("_y", near("_y")).withColumn("_x", near("_x")).select(*key, "_y", "_x", F.col(id_col).alias("a"), F.col("lat").alias("la"), F.col("lng").alias("ga"))
    right = cell.select(*key, "_y", "_x", F.col(id_col).alias("b"), F.col("lat").alias("lb"), F.col("lng").alias("gb"))
    both = left.join(right, [*key, "_y", "_x"]).where("a < b")
    return both.where(geo.haversine(F.col("la"), F.col("ga"), F.col("lb"), F.col("gb")) <= metres).select("a", "b")


def similar_pairs(names: DataFrame, least: float, name: str = "name") -> DataFrame:
    """(a, b, similarity) of distinct names, a < b, whose trigrams overlap by `least` or more: names meet on one of their
    rarest trigrams only, of which two similar ones share one, and are then scored."""
    from ridgeline.functions import text

    grams = names.select(F.col(name).alias("name")).distinct().withColumn("grams", text.trigrams(F.col("name"))).where("size(grams) > 0")
    each = grams.select("name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("of"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("of", "gram"))), lambda x: x["gram"])
    ranked = each.join(common, "gram").groupBy("name").agg(F.first("n").alias("n"), order.alias("grams"))
    dealt = ranked.select("name", "n", F.explode(F.slice("grams", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("gram"))
    side = lambda s: dealt.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"), "gram")
    met = side("a").join(side("b"), "gram").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)).select("a", "b").distinct()
    return met.withColumn("similarity", text.similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least)


def group_edges(df: DataFrame, key: Sequence[Column], id_col: str) -> DataFrame:
    """(a, b): every member of a group to its least one; a line for each member, not for each pair."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    rows = df.select(F.col(id_col).alias("b"), *named)
    least = rows.groupBy(*(f"_k{i}" for i in range(len(key)))).agg(F.min("b").alias("a"))
    return rows.join(least, [f"_k{i}" for i in range(len(key))]).where("a < b").select("a", "b")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable. Labels halve their paths in each round; the state is written
    to the shared folder, so rounds neither lengthen the lineage nor depend on single executors."""
    links = shared_table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = shared_table(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    for _ in range(most):
        seen = links.join(state, links["b"] == state["node"]).groupBy("a").agg(F.min("root").alias("via"))
        nearer = state.join(seen, F.col("node") == F.col("a")).select("node", "root", F.least("root", "via").alias("new"))
        hop = state.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = nearer.join(hop, F.col("new") == F.col("_n")).select("node", F.least("new", "_r").alias("root"), (F.least("new", "_r") < F.col("root")).alias("changed"))
        after = shared_table(jumped, "labels")
        changed = after.where("changed").limit(1).count()
        state = after.select("node", "root")
        if not changed:
            return state
    raise RuntimeError(f"labels did not settle in {most} rounds")


def best_match(pairs: DataFrame, key: str, by: Sequence[Column]) -> DataFrame:
    return first_by(pairs, [key], by)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """old with rows of new in place of those with the same keys, one row a key; new columns are null in old rows.

    Of rows of new that repeat a key the last by `order` is kept; without an order, the greatest by all their columns,
    so that a run done again gives the same.
    """
    rows = F.struct(*new.columns)
    last = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), *(c for c in new.columns if not isinstance(new.schema[c].dataType, MapType)))
    new = new.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(rows, last).alias("_r")).select("_r.*")
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_part(old: DataFrame, incoming: DataFrame, part: Column) -> DataFrame:
    """old without the rows of a part (a condition), with all of incoming, which may be empty."""
    return old.where(~F.coalesce(part, F.lit(False))).unionByName(incoming, allowMissingColumns=True)


def merge_region(old: Sequence[DataFrame], incoming: Sequence[DataFrame], part: Column, keys: Sequence[str]) -> list[DataFrame]:
    """Tables that hang on each other (the first has the region, each next one the key of the one before) with all rows of a
    region, and all that hang on them, replaced by the incoming ones; rows that hang on nothing stay."""
    gone = old[0].where(F.coalesce(part, F.lit(False)))
    out = [replace_part(old[0], incoming[0], part)]
    for table, new, key in zip(old[1:], incoming[1:], keys, strict=True):
        away = gone.select(key).distinct()
        gone = table.join(away, key, "left_semi")
        out.append(table.join(away, key, "left_anti").select(*table.columns).unionByName(new, allowMissingColumns=True))
    return out

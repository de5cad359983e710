"""Links between points that lie near each other, as many as there are points and neighbouring cells.

Points are dealt into cells whose diagonal is the reach, so all points of a cell belong together: each gets one link
to the cell's least id. Two cells belong together if any point of the one reaches any point of the other. Where the
two hold few points these meet directly; else both are cut into quarters again and again: a pair of parts that is too
far apart goes, one that lies within reach as a whole settles its cells, and the rest is cut further. Components over
these links are those over all near pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import geo
from ridgeline.operators.entity import shared_table

DIRECT = 256  # pairs of points of two cells that are compared one by one
DEEPEST = 24  # cuts: parts of a millionth of a metre
DEGREE = geo.RADIUS_M * 3.141592653589793 / 180
SLACK = 1e-6  # bounds on a plane differ from the sphere's by much less


def _step(row: Column, high: float) -> Column:
    """Width of the cells of a row in degrees: the reach's share of metres where the row is nearest to the equator."""
    nearest = F.when(row >= 0, row * high).otherwise(F.when(row == -1, 0.0).otherwise((row + 1) * high))
    return F.lit(high) / F.greatest(F.cos(F.radians(nearest)), F.lit(0.01))


def near_links(points: DataFrame, key: Sequence[str], metres: float, id_col: str) -> DataFrame:
    """(a, b), a < b: links whose components are those of the points of one key at most `metres` apart.

    Points without a latitude, a longitude or any part of the key have no links. Latitudes beyond 89 degrees and the
    date line aren't joined. One link for each point that isn't alone in its cell, and one for each pair of
    neighbouring cells that belong together.
    """
    key, high = list(key), metres / 2**0.5 / DEGREE
    named = points.select(*key, F.col(id_col).alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).dropna()
    row = F.floor(F.col("lat") / high)
    placed = named.withColumn("y", row).withColumn("x", F.floor(F.col("lng") / _step(F.col("y"), high)))
    placed = shared_table(placed, "placed")
    cell = [*key, "y", "x"]
    places = placed.groupBy(*cell, "lat", "lng").agg(F.min("id").alias("id"))
    cells = shared_table(places.groupBy(*cell).agg(F.min("id").alias("rep"), F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("lo", F.min), ("hi", F.max)))), "cells")
    inside = placed.join(cells.select(*cell, "rep"), cell).where("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    between = _between(shared_table(places, "places"), cells, key, metres, high)
    return inside.unionByName(between)


def _apart(a: str, b: str, far: bool) -> Column:
    """Least or greatest distance that points of two boxes can have, with slack to the safe side."""
    north = F.greatest(*(F.abs(F.col(f"{s}.{e}_lat")) for s in (a, b) for e in ("lo", "hi")))
    south = F.when((F.least(F.col(f"{a}.lo_lat"), F.col(f"{b}.lo_lat")) <= 0) & (F.greatest(F.col(f"{a}.hi_lat"), F.col(f"{b}.hi_lat")) >= 0), 0.0).otherwise(F.least(*(F.abs(F.col(f"{s}.{e}_lat")) for s in (a, b) for e in ("lo", "hi"))))

    def along(c: str) -> Column:
        lo, hi = (lambda s: F.col(f"{s}.lo_{c}")), (lambda s: F.col(f"{s}.hi_{c}"))
        return F.greatest(hi(a) - lo(b), hi(b) - lo(a)) if far else F.greatest(lo(a) - hi(b), lo(b) - hi(a), F.lit(0.0))

    wide = along("lng") * F.cos(F.radians(south if far else north))
    flat = F.sqrt(along("lat") * along("lat") + wide * wide) * DEGREE
    return flat * (1 + SLACK) if far else flat * (1 - SLACK)


def _boxes(places: DataFrame, by: Sequence[str]) -> DataFrame:
    return places.groupBy(*by).agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("lo", F.min), ("hi", F.max))))


def _between(places: DataFrame, cells: DataFrame, key: list[str], metres: float, high: float) -> DataFrame:
    """(a, b): the least ids of neighbouring cells that hold points within reach."""
    # Rows up to two on, and their cells from this one's western reach to its eastern.
    edge = F.greatest(F.abs("lo_lat"), F.abs("hi_lat")) + 2 * high
    reach = F.lit(metres / DEGREE * (1 + SLACK)) / F.greatest(F.cos(F.radians(edge)), F.lit(0.01))
    near = cells.select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("_dy"), reach.alias("_r")).withColumn("_y", F.col("y") + F.col("_dy"))
    column = lambda lng: F.floor(lng / _step(F.col("_y"), high))
    near = near.withColumn("_x", F.explode(F.sequence(column(F.col("lo_lng") - F.col("_r")), column(F.col("hi_lng") + F.col("_r"))))).where("_dy > 0 or _x > x")
    box = F.struct("rep", "y", "x", "n", "lo_lat", "hi_lat", "lo_lng", "hi_lng")
    a = near.select(*key, F.col("_y").alias("y"), F.col("_x").alias("x"), box.alias("a"))
    pairs = a.join(cells.select(*key, "y", "x", box.alias("b")), [*key, "y", "x"]).drop("y", "x")
    part = lambda s: F.struct(*(F.col(f"{s}.{c}") for c in ("rep", "y", "x")), F.lit(0).cast("long").alias("fy"), F.lit(0).cast("long").alias("fx"), *(F.col(f"{s}.{c}") for c in ("n", "lo_lat", "hi_lat", "lo_lng", "hi_lng")))
    open_ = pairs.where(_apart("a", "b", False) <= metres).select(*key, part("a").alias("a"), part("b").alias("b"))
    ends = ["a.rep", "b.rep"]
    settled = None
    for level in range(DEEPEST + 1):
        open_ = shared_table(open_, "open")
        within = open_.where(_apart("a", "b", True) <= metres).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
        small = F.col("a.n") * F.col("b.n") <= (DIRECT if level < DEEPEST else 2**62)
        few = open_.where(small & (_apart("a", "b", True) > metres))
        met = _points(_points(few.select(*key, F.col("a").alias("p"), F.col("b").alias("q")), places, key, level, high, "p"), places, key, level, high, "q")
        met = met.where(geo.haversine(F.col("p_lat"), F.col("p_lng"), F.col("q_lat"), F.col("q_lng")) <= metres).select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
        found = shared_table(within.unionByName(met).distinct(), "settled")
        settled = found if settled is None else settled.unionByName(found)
        rest = open_.where(~small & (_apart("a", "b", True) > metres)).join(found.toDF("_a", "_b"), (F.col("a.rep") == F.col("_a")) & (F.col("b.rep") == F.col("_b")), "left_anti")
        if not rest.limit(1).count():
            break
        rest = _parts(_parts(rest, places, key, level, high, "a"), places, key, level, high, "b")
        open_ = rest.where(_apart("a", "b", False) <= metres)
    both = settled.distinct()
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _cut(level: int, high: float) -> list[Column]:
    """Where a point lies in its cell, cut `level` times."""
    scale = 2.0**level
    fine = lambda x: F.floor((x - F.floor(x)) * scale)
    return [fine(F.col("lat") / high).alias("fy"), fine(F.col("lng") / _step(F.col("y"), high)).alias("fx")]


def _points(pairs: DataFrame, places: DataFrame, key: list[str], level: int, high: float, side: str) -> DataFrame:
    """Pairs of parts with each point of one side's part."""
    here = places.select(*key, "y", "x", *_cut(level, high), F.col("lat").alias(f"{side}_lat"), F.col("lng").alias(f"{side}_lng"))
    on = [F.col(f"{side}.{c}").alias(c) for c in ("y", "x", "fy", "fx")]
    return pairs.select("*", *on).join(here, [*key, "y", "x", "fy", "fx"]).drop("y", "x", "fy", "fx")


def _parts(pairs: DataFrame, places: DataFrame, key: list[str], level: int, high: float, side: str) -> DataFrame:
    """Pairs with one side's part replaced by each of its quarters that holds points."""
    by = [*key, "y", "x", "fy", "fx"]
    finer = _boxes(places.select(*key, "y", "x", *_cut(level + 1, high), "lat", "lng"), by)
    child = F.struct(F.col(f"{side}.rep").alias("rep"), "y", "x", F.col("fy"), F.col("fx"), "n", "lo_lat", "hi_lat", "lo_lng", "hi_lng")
    quarters = finer.withColumns({"_py": F.floor(F.col("fy") / 2), "_px": F.floor(F.col("fx") / 2)})
    on = [F.col(f"{side}.y").alias("y"), F.col(f"{side}.x").alias("x"), F.col(f"{side}.fy").alias("_py"), F.col(f"{side}.fx").alias("_px")]
    met = pairs.select("*", *on).join(quarters, [*key, "y", "x", "_py", "_px"])
    return met.select(*key, *(child.alias(s) if s == side else F.col(s) for s in ("a", "b")))

"""Nearest polygon of points, by cells that the polygons' edges pass through.

A point's cell looks only at cells that may hold something nearer than the nearest cell
with an edge promises, so every edge that can be nearest is compared and few others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import raster

KEY = "session_id"
#: Side of a cell, in the points' unit.
CELL = 16


def segments(polygons: DataFrame, key: str = KEY) -> DataFrame:
    """(key, region, au, av, bu, bv): the edges of polygons ``poly`` (array of u, v), the last to the first."""
    p = F.col("poly")
    edges = F.transform(p, lambda a, i: F.struct(a.alias("a"), F.element_at(p, (i + 1) % F.size(p) + 1).alias("b")))
    rows = polygons.select(key, "region", F.explode(edges).alias("e"))
    return rows.select(key, "region", *(F.col(f"e.{end}.{c}").cast("double").alias(f"{end}{c}") for end in "ab" for c in "uv"))


def squared(u: Column, v: Column) -> Column:
    """Squared distance of (u, v) to the segment of the row."""
    du, dv = F.col("bu") - F.col("au"), F.col("bv") - F.col("av")
    size = du * du + dv * dv
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((u - F.col("au")) * du + (v - F.col("av")) * dv) / size)))
    x, y = u - (F.col("au") + t * du), v - (F.col("av") + t * dv)
    return x * x + y * y


def _cells(edges: DataFrame, cell: int) -> DataFrame:
    """``edges`` with a row for each cell (cu, cv) that a piece of an edge may pass through."""
    long = F.greatest(F.abs(F.col("bu") - F.col("au")), F.abs(F.col("bv") - F.col("av")))
    rows = edges.withColumn("n", F.greatest(F.lit(1), F.ceil(long / cell)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    for c in "uv":
        ends = [F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (F.col("k") + d) / F.col("n") for d in (0, 1)]
        # a piece that lies on a border between cells belongs to both
        low, high = F.floor((F.least(*ends) - 1e-6) / cell), F.floor((F.greatest(*ends) + 1e-6) / cell)
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(low, high)))
    return rows.drop("n", "k").distinct()


def nearest_polygon(points: DataFrame, polygons: DataFrame, cell: int = CELL, key: str = KEY) -> DataFrame:
    """(key, u, v, region, d2): the polygon whose edges are nearest to each point, ties to the lower region.

    ``polygons``: key, region (0 is the main), poly; points without a polygon in their scan drop out.
    """
    # of polygons with an edge in common only the lowest can win by it
    ends = [key, "au", "av", "bu", "bv"]
    edges = _cells(segments(polygons, key).groupBy(*ends).agg(F.min("region").alias("region")), cell)
    at = {f"c{c}": F.floor(F.col(c) / cell) for c in "uv"}
    placed = points.select(key, "u", "v").withColumns(at)
    mine, held = (df.select(key, "cu", "cv").distinct() for df in (placed, edges))
    both = mine.withColumn("mine", F.lit(True)).unionByName(held.withColumn("mine", F.lit(False)))
    box = both.groupBy(key).agg(*(f(c).alias(n + c) for c in ("cu", "cv") for f, n in ((F.min, "low_"), (F.max, "high_"))))
    grid = box.withColumn("cu", F.explode(F.sequence("low_cu", "high_cu"))).withColumn("cv", F.explode(F.sequence("low_cv", "high_cv")))
    there = held.withColumn("there", F.lit(True))
    label = F.when(F.col("there"), (F.col("cv") - F.col("low_cv")) * F.lit(1 << 20) + F.col("cu") - F.col("low_cu"))
    dense = grid.join(there, [key, "cu", "cv"], "left").select(key, F.col("cu").alias("u"), F.col("cv").alias("v"), label.alias("label"))
    nearest = raster.nearest_fill(dense, "label", key).filter("label is not null").withColumnsRenamed({"u": "cu", "v": "cv"})
    nearest = nearest.join(mine, [key, "cu", "cv"]).join(box.select(key, "low_cu", "low_cv"), key)
    du = F.abs(F.col("label") % (1 << 20) + F.col("low_cu") - F.col("cu")) + 1
    dv = F.abs(F.floor(F.col("label") / (1 << 20)) + F.col("low_cv") - F.col("cv")) + 1
    # no farther, in cells, than from corner to corner
    reach = nearest.select(key, "cu", "cv", (du * du + dv * dv).alias("far"))
    reach = reach.withColumn("r", F.floor(F.sqrt("far")).cast("int") + 1)
    for c in ("u", "v"):
        reach = reach.withColumn(f"d{c}", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    gap = lambda c: F.greatest(F.abs(F.col(c)) - 1, F.lit(0))
    reach = reach.filter(gap("du") * gap("du") + gap("dv") * gap("dv") <= F.col("far"))
    looked = reach.select(key, F.col("cu").alias("pu"), F.col("cv").alias("pv"), (F.col("cu") + F.col("du")).alias("cu"), (F.col("cv") + F.col("dv")).alias("cv"))
    pairs = looked.join(edges, [key, "cu", "cv"]).drop("cu", "cv").distinct().withColumnsRenamed({"pu": "cu", "pv": "cv"})
    met = placed.join(pairs, [key, "cu", "cv"]).withColumn("d2", squared(F.col("u").cast("double"), F.col("v").cast("double")))
    best = met.groupBy(key, "u", "v").agg(F.min(F.struct("d2", "region")).alias("best"))
    return best.select(key, "u", "v", "best.region", "best.d2")


def within(d: float) -> Column:
    """Whether a point's nearest edge is at most ``d`` away."""
    return F.col("d2") <= math.pow(d, 2)

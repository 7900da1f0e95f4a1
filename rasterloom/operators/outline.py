"""Outlines of masks as tables: boundary sides joined end to end, ranked by pointer doubling.

Every side between a pixel of a mask and one that isn't in it is directed so that the
mask lies to its right (v pointing down).  Which side follows depends on the eight
neighbours alone, so straight runs of sides shrink to one row before anything is
joined; what the doubling moves is corners, in as many rounds as the logarithm of the
longest ring's corners.  No task holds a mask: the largest group is one ring's corners,
which the result holds as an array anyway.

Diagonal pixels of a mask touch, diagonal gaps don't.  Points are pixels of the mask:
an outer ring runs clockwise over its own border pixels, a hole's ring over those
around the hole, as seen from inside the mask.  A pixel passed twice, on its way out and
back, is there twice.  Repeated pixels count once; an empty mask has no rings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import kernels, raster
from rasterloom.storage import save, scratch

KEY = "session_id"
POINTS = "array<struct<u:int,v:int>>"
#: Bits of a column of three pixels.
ABOVE, HERE, BELOW = 1, 2, 4
#: Pixels may lie this far from the origin either way.
SPAN = 1 << 24


def _side(u: Column, v: Column, side: int) -> Column:
    """A side's id, ascending by (v, u, side); sides are top, right, bottom, left."""
    return ((v.cast("long") + SPAN) * (4 * SPAN) + u.cast("long") + SPAN) * 4 + side


def neighbours(masks: DataFrame, by: list[str]) -> DataFrame:
    """(by, u, v, n, e, s, w, ne, se, sw, nw): each pixel and whether its neighbours are in its mask."""
    shift = F.explode(F.array(*(F.struct(F.lit(dv).alias("dv"), F.lit(bit).alias("bit")) for dv, bit in ((1, ABOVE), (0, HERE), (-1, BELOW)))))
    stacked = masks.select(*by, "u", "v", shift.alias("s")).groupBy(*by, "u", (F.col("v") + F.col("s.dv")).alias("v")).agg(F.bit_or("s.bit").alias("here"))
    line = Window.partitionBy(*by, "v").orderBy("u")
    beside = {c: F.when(f("u").over(line) == F.col("u") + d, f("here").over(line)).otherwise(F.lit(0)) for c, f, d in (("left", F.lag, -1), ("right", F.lead, 1))}
    rows = stacked.withColumns(beside).filter(F.col("here").bitwiseAND(F.lit(HERE)) != 0)
    has = lambda c, bit: F.col(c).bitwiseAND(F.lit(bit)) != 0
    places = {"n": ("here", ABOVE), "e": ("right", HERE), "s": ("here", BELOW), "w": ("left", HERE), "ne": ("right", ABOVE), "se": ("right", BELOW), "sw": ("left", BELOW), "nw": ("left", ABOVE)}
    return rows.select(*by, "u", "v", *(has(*of).alias(c) for c, of in places.items()))


#: Of each side: the neighbour across, straight ahead, ahead across, behind, behind across;
#: the step along it; the corner of the pixel that it starts from.
SIDES = [
    ("n", "e", "ne", "w", "nw", (1, 0), (0, 0)),
    ("e", "s", "se", "n", "ne", (0, 1), (1, 0)),
    ("s", "w", "sw", "e", "se", (-1, 0), (1, 1)),
    ("w", "n", "nw", "s", "sw", (0, -1), (0, 1)),
]
ACROSS = [(0, -1), (1, 0), (0, 1), (-1, 0)]


def corners(masks: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, next, side, u0, v0, u1, v1): the straight runs of sides, from first to last pixel."""
    u, v = F.col("u"), F.col("v")
    ends = []
    for k, (over, ahead, across, behind, gone, (du, dv), _) in enumerate(SIDES):
        eu, ev = ACROSS[k]
        onward = F.when(F.col(across), _side(u + du + eu, v + dv + ev, (k + 3) % 4)).when(F.col(ahead), _side(u + du, v + dv, k)).otherwise(_side(u, v, (k + 1) % 4))
        first, last = ~(F.col(behind) & ~F.col(gone)), F.col(across) | ~F.col(ahead)
        line, place = (v, u * du) if du else (u, v * dv)
        side = F.struct(F.lit(k).alias("side"), line.alias("line"), place.alias("place"), _side(u, v, k).alias("id"), first.alias("first"), last.alias("last"), onward.alias("next"))
        ends.append(F.when(~F.col(over) & (first | last), side))
    sides = neighbours(masks, by).select(*by, "u", "v", F.explode(F.filter(F.array(*ends), lambda s: s.isNotNull())).alias("s")).select(*by, "u", "v", "s.*")
    run = Window.partitionBy(*by, "side", "line").orderBy("place")
    end = lambda c: F.when(F.col("last"), F.col(c)).otherwise(F.lead(c).over(run))
    rows = sides.withColumns({"u1": end("u"), "v1": end("v"), "onward": end("next")}).filter("first")
    return rows.select(*by, "id", F.col("onward").alias("next"), "side", u.alias("u0"), v.alias("v0"), "u1", "v1")


def ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (by, id, next), closed rings of any number, plus ``ring``, the least id of each, and ``rank`` from it.

    Each round doubles how far ahead a node has looked for the least id and how far away
    that is; where no node finds a smaller one, all have seen their whole ring.
    """
    spark = nodes.sparkSession
    with scratch(spark):
        seen = nodes.withColumns({"ring": F.col("id"), "ahead": F.lit(0).cast("long")})
        seen = save(seen.withColumn("least", F.struct("ring", "ahead")).drop("ring", "ahead").withColumn("lower", F.lit(True)), "rings")
        width = 1
        while not seen.filter("lower").isEmpty():
            there = seen.select(*by, F.col("id").alias("next"), F.col("next").alias("__next"), F.struct(F.col("least.ring"), (F.col("least.ahead") + width).alias("ahead")).alias("__least"))
            met = seen.join(there, [*by, "next"])
            lower = F.col("__least.ring") < F.col("least.ring")
            columns = [c for c in seen.columns if c not in ("next", "least", "lower")]
            met = met.select(*columns, F.col("__next").alias("next"), F.least("least", "__least").alias("least"), lower.alias("lower"))
            seen = save(met, "rings", spent=[seen])
            width *= 2
        rows = seen.drop("next", "lower").withColumn("ring", F.col("least.ring"))
        size = rows.groupBy(*by, "ring").agg(F.count("*").alias("__n"))
        rank = (F.col("__n") - F.col("least.ahead")) % F.col("__n")
        return save(rows.join(size, [*by, "ring"]).withColumn("rank", rank).drop("__n", "least"), "ranked", keep=True)


def _cross(points: Column, x: str, y: str) -> Column:
    """Twice the signed area of an array of points, clockwise positive."""
    terms = F.transform(points, lambda a, i: a[x].cast("long") * F.element_at(points, (i + 1) % F.size(points) + 1)[y] - F.element_at(points, (i + 1) % F.size(points) + 1)[x] * a[y].cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + t)


def rings(masks: DataFrame, by: list[str]) -> DataFrame:
    """(by, ring, hole, pixels, sides, points, area): every ring of every mask (by, u, v).

    ``ring`` ascends by the first pixel by (v, u); ``pixels`` lie within the ring, holes of
    it counted in; ``sides`` is its length; ``area`` that of the polygon of the ``points``,
    corners in pixels without those inside straight lines.
    """
    rows = ranked(corners(masks, by), by)
    start = [(F.col(f"{c}0") + F.element_at(F.array(*(F.lit(s[6][k]) for s in SIDES)), F.col("side") + 1)).alias(c) for k, c in enumerate("uv")]
    ends = F.array(*(F.struct(F.col(f"u{k}").cast("int").alias("u"), F.col(f"v{k}").cast("int").alias("v")) for k in (0, 1)))
    sides = F.abs(F.col("u1") - F.col("u0")) + F.abs(F.col("v1") - F.col("v0")) + 1
    found = rows.groupBy(*by, "ring").agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*start).alias("at"), ends.alias("ends")))).alias("all"), F.sum(sides).alias("sides"))
    found = found.withColumn("__a", _cross(F.col("all.at"), "u", "v")).withColumn("__p", F.flatten("all.ends"))
    # a corner's pixel ends one run and begins the next
    found = found.withColumn("__p", F.filter("__p", lambda p, i: (i == 0) | (p != F.element_at("__p", F.greatest(i, F.lit(1))))))
    closes = (F.size("__p") > 1) & (F.element_at("__p", -1) == F.element_at("__p", 1))
    points = F.slice("__p", F.lit(1), F.size("__p") - closes.cast("int"))
    found = found.withColumn("points", points).withColumn("area", F.abs(_cross(F.col("points"), "u", "v")) / 2)
    return found.select(*by, "ring", (F.col("__a") < 0).alias("hole"), (F.abs(F.col("__a")) / 2).cast("long").alias("pixels"), "sides", "points", "area")


def simplified(points: Column, eps: float) -> Column:
    """A ring's points without those within ``eps`` of its chords; null where fewer than three stay."""

    @F.pandas_udf("array<int>")
    def kept(us: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(kernels.kept(np.stack([u, v], axis=1).astype(float), eps)).astype(np.int32) for u, v in zip(us, vs)])

    places = kept(points["u"], points["v"])
    return F.when(F.size(places) >= 3, F.transform(places, lambda i: F.element_at(points, i + 1)))


def largest(found: DataFrame, by: list[str], eps: float) -> DataFrame:
    """(by, points): each mask's outer ring of largest area, simplified; masks whose ring has no area drop out."""
    best = found.filter("not hole").groupBy(*by).agg(F.max_by("points", F.struct("area", -F.col("ring"))).alias("points"))
    return best.withColumn("points", simplified(F.col("points"), eps)).filter("points is not null")


def shells(comps: DataFrame, by: list[str], eps: float) -> DataFrame:
    """(by, comp, shell, holes): the outer ring and the holes of each component (by, comp, u, v), simplified."""
    whole = [*by, "comp"]
    found = rings(comps.select(*whole, "u", "v"), whole).withColumn("points", simplified(F.col("points"), eps)).filter("points is not null")
    holes = F.transform(F.sort_array(F.collect_list(F.when(F.col("hole"), F.struct("ring", "points")))), lambda h: h["points"])
    both = found.groupBy(*whole).agg(F.max(F.when(~F.col("hole"), F.col("points"))).alias("shell"), holes.alias("holes"))
    return both.filter("shell is not null")


def to_world(points: Column, max_x: Column, max_z: Column, ppm: float) -> Column:
    """array<struct<x, z>> in metres of points in pixels."""
    return F.transform(points, lambda p: F.struct((max_x - p["u"] / ppm).alias("x"), (max_z - p["v"] / ppm).alias("z")))


def in_world(masks: DataFrame, grid: DataFrame, by: list[str], ppm: float, simplify_m: float = 0.04, key: str = KEY) -> DataFrame:
    """(by, polygon): each mask's largest outline in metres; ``grid`` has key, max_x, max_z.

    Regions are simplified to 0.04 m, the footprint of a whole scan to 0.15 m.
    """
    found = largest(rings(masks, by), by, max(1.0, simplify_m * ppm)).join(grid.select(key, "max_x", "max_z"), key)
    return found.select(*by, to_world(F.col("points"), F.col("max_x"), F.col("max_z"), ppm).alias("polygon"))


def of_labels(labels: DataFrame, eps: float, key: str = KEY) -> DataFrame:
    """(key, label, shell, holes): each label's component of most pixels as polygons; negative labels are none."""
    comps = save(raster.components(labels.filter("label >= 0"), "label", key), "label-comps")
    size = comps.groupBy(key, "label", "comp").agg(F.count("*").alias("n"))
    best = size.groupBy(key, "label").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"))
    return shells(comps.join(best, [key, "label", "comp"], "left_semi"), [key, "label"], eps).drop("comp")

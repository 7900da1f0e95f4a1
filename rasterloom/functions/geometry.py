"""Polygon geometry as Column expressions over ``array<struct<x, z>>``.

The closing edge is implied.  Everything here is built from higher-order functions,
so it runs inside the plan of the query that uses it, one polygon per row, and
nothing is shuffled.  Ties go to the lowest index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest edge that gets a dimension (m), and its label's offset (m).
SHORT_EDGE, LABEL_OFFSET = 1e-3, 0.18
#: Fixed value: squared length under which an edge counts as a point.
POINT_EDGE = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def polygon(points: list[tuple[float, float]]) -> Column:
    """A literal polygon."""
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in points))


def edges(poly: Column | str) -> Column:
    """array<struct<i, a, b>>: each vertex with its successor, wrapping round."""
    p = _c(poly)
    return F.transform(p, lambda a, i: F.struct(i.alias("i"), a.alias("a"), F.element_at(p, (i + 1) % F.size(p) + 1).alias("b")))


def area(poly: Column | str) -> Column:
    """Shoelace area, 0 for fewer than three vertices."""
    terms = F.transform(edges(poly), lambda e: e["a"]["x"] * e["b"]["z"] - e["b"]["x"] * e["a"]["z"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def contains(poly: Column | str, x: Column, z: Column) -> Column:
    """Ray cast to the right with the half-open rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["x"] - a["x"]) * (z - a["z"]) / (b["z"] - a["z"]) + a["x"]
        return F.when((a["z"] > z) != (b["z"] > z), x < at).otherwise(F.lit(False))

    return F.aggregate(F.transform(edges(poly), crosses), F.lit(False), lambda odd, c: odd != c)


def closest_vertex(poly: Column | str, x: Column, z: Column) -> Column:
    """struct<distance, i>; null for an empty polygon."""
    return F.array_min(F.transform(_c(poly), lambda p, i: F.struct(F.hypot(p["x"] - x, p["z"] - z).alias("distance"), i.alias("i"))))


def closest_edge(poly: Column | str, x: Column, z: Column) -> Column:
    """struct<distance, i, x, z> of the nearest point on an edge; point-like edges are skipped."""

    def foot(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dz = b["x"] - a["x"], b["z"] - a["z"]
        square = dx * dx + dz * dz
        t = F.least(F.greatest(((x - a["x"]) * dx + (z - a["z"]) * dz) / square, F.lit(0.0)), F.lit(1.0))
        fx, fz = a["x"] + t * dx, a["z"] + t * dz
        near = F.struct(F.hypot(x - fx, z - fz).alias("distance"), e["i"].alias("i"), fx.alias("x"), fz.alias("z"))
        return F.when(square >= POINT_EDGE, near)

    return F.array_min(F.filter(F.transform(edges(poly), foot), lambda s: s.isNotNull()))


def _checked(ok: Column, value: Column, said: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(said)))


def insert_vertex(poly: Column | str, edge: Column, point: Column) -> Column:
    """The polygon with ``point`` after vertex ``edge``."""
    p = _c(poly)
    new = F.concat(F.slice(p, F.lit(1), edge + 1), F.array(point), F.slice(p, edge + 2, F.size(p)))
    return _checked((edge >= 0) & (edge < F.size(p)), new, "edge index out of range")


def move_vertex(poly: Column | str, index: Column, point: Column) -> Column:
    p = _c(poly)
    return _checked((index >= 0) & (index < F.size(p)), F.transform(p, lambda v, i: F.when(i == index, point).otherwise(v)), "vertex index out of range")


def delete_vertex(poly: Column | str, index: Column) -> Column:
    p = _c(poly)
    new = _checked((index >= 0) & (index < F.size(p)), F.filter(p, lambda v, i: i != index), "vertex index out of range")
    return _checked(F.size(p) > 3, new, "a polygon needs three vertices")


def delete_chain(poly: Column | str, i: Column, j: Column, direction: str = "short") -> Column:
    """Removes the vertices strictly between ``i`` and ``j``.

    ``forward`` goes from i up to j, ``backward`` the other way round; ``short`` takes
    whichever removes fewer, ties going forward.
    """
    p = _c(poly)
    n = F.size(p)
    ahead, back = F.pmod(j - i, n) - 1, F.pmod(i - j, n) - 1

    def forward(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.concat(F.slice(p, F.lit(1), a + 1), F.slice(p, b + 1, n))).otherwise(F.slice(p, b + 1, a - b + 1))

    take = {"forward": F.lit(True), "backward": F.lit(False), "short": ahead <= back}[direction]
    new = F.when(take, forward(i, j)).otherwise(forward(j, i))
    inside = (i >= 0) & (i < n) & (j >= 0) & (j < n) & (i != j)
    return _checked(inside, _checked(F.size(new) >= 3, new, "a polygon needs three vertices"), "vertex index out of range")


def vertex_mean(poly: Column | str) -> Column:
    """struct<x, z>: the mean of the vertices (not the area's centroid)."""
    p = _c(poly)
    return F.struct(*((F.aggregate(along, F.lit(0.0), lambda s, c: s + c) / F.size(p)).alias(k) for k, along in (("x", p["x"]), ("z", p["z"]))))


def extent(poly: Column | str, pad: float = 0.5) -> Column:
    """struct<min_x, max_x, min_z, max_z, page_height> of a padded plan page."""
    p = _c(poly)
    low, high = ([f(p[k]) for k in ("x", "z")] for f in (F.array_min, F.array_max))
    low, high = [c - pad for c in low], [c + pad for c in high]
    aspect = (high[0] - low[0]) / (high[1] - low[1])
    return F.struct(low[0].alias("min_x"), high[0].alias("max_x"), low[1].alias("min_z"), high[1].alias("max_z"), F.greatest(F.lit(8.5), 11 / aspect).alias("page_height"))


def dimensions(poly: Column | str) -> Column:
    """array<struct<i, length_mm, x, z, angle>>: a label for each edge, outside the room."""
    p = _c(poly)
    mid = vertex_mean(p)

    def label(e: Column) -> Column:
        a, b = e["a"], e["b"]
        dx, dz = b["x"] - a["x"], b["z"] - a["z"]
        size = F.hypot(dx, dz)
        mx, mz = (a["x"] + b["x"]) / 2, (a["z"] + b["z"]) / 2
        nx, nz = -dz / size, dx / size
        side = F.when(nx * (mx - mid["x"]) + nz * (mz - mid["z"]) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        turn = F.degrees(F.atan2(dz, dx))
        turn = F.when(turn > 90, turn - 180).when(turn < -90, turn + 180).otherwise(turn)
        made = F.struct(
            e["i"].alias("i"), F.bround(size * 1000).cast("long").alias("length_mm"), (mx + side * nx * LABEL_OFFSET).alias("x"), (mz + side * nz * LABEL_OFFSET).alias("z"), turn.alias("angle")
        )
        return F.when(size >= SHORT_EDGE, made)

    return F.filter(F.transform(edges(p), label), lambda s: s.isNotNull())


def long_edges(poly: Column | str, least: float) -> Column:
    """Keeps a vertex only if it is ``least`` away from the last kept one.

    Polygons of fewer than four vertices stay; a last vertex too close to the first
    goes if more than three are left.
    """
    p = _c(poly)

    def far(a: Column, b: Column) -> Column:
        return F.hypot(a["x"] - b["x"], a["z"] - b["z"]) >= least

    kept = F.aggregate(F.slice(p, F.lit(2), F.size(p)), F.slice(p, F.lit(1), F.lit(1)), lambda acc, v: F.when(far(F.element_at(acc, -1), v), F.concat(acc, F.array(v))).otherwise(acc))
    closed = F.when((F.size(kept) > 3) & ~far(F.element_at(kept, -1), F.element_at(kept, 1)), F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
    return F.when(F.size(p) < 4, p).otherwise(closed)


def world_to_px(x: Column, z: Column, max_x: float, max_z: float, ppm: float) -> tuple[Column, Column]:
    return (F.lit(max_x) - x) * ppm, (F.lit(max_z) - z) * ppm


def px_to_world(u: Column, v: Column, max_x: float, max_z: float, ppm: float) -> tuple[Column, Column]:
    return F.lit(max_x) - u / ppm, F.lit(max_z) - v / ppm

"""Graph-based segmentation by contraction of arrays, whole or over tiles.

The published rule takes edges by ascending cost and joins two components if the cost is
within both of their tolerances: inner cost + scale / size.  Here it runs in rounds.  A
component's reach is the cost up to which its edges, taken in order, would each be within
the tolerance left by those before; every component then joins along its cheapest edge
within both reaches.  A component that reaches none of its edges is done, and so are they.
Rounds are about as many as the logarithm of the largest component, each a few sorts.
Results agree with the sequential rule in kind, not pixel by pixel.

Tiles: each tile is contracted alone, from pixels blurred with a halo; a component whose
cheapest edge crosses the tile's border waits.  What is left, its
components and the cheapest edge between any two of them, within the tile and across its
borders, is the seam graph of the scan, to which the same rule applies in one group.
"""

from __future__ import annotations

import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import kernels, raster
from rasterloom.storage import save

KEY = "session_id"
STEPS = ((0, 1), (1, 0), (1, 1), (1, -1))
#: Pixels along the side of a tile.
TILE = 512


def mark(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an edge by its pixels' numbers; orders edges of equal cost."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(1)


class Graph:
    """Components 0 to n - 1 with sizes and inner costs, and edges in order of cost.

    ``outside`` components aren't touched; one whose cheapest edge leads there waits.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, cost: np.ndarray, order: np.ndarray, size: np.ndarray, inner: np.ndarray, outside: np.ndarray | None = None):
        rank = np.lexsort((order, cost))
        self.a, self.b, self.cost, self.order = a[rank], b[rank], cost[rank], order[rank]
        self.size, self.inner = size.copy(), inner.copy()
        self.root = np.arange(len(size))
        self.outside = np.zeros(len(size), bool) if outside is None else outside

    def fresh(self) -> Graph:
        """The same graph of pixels, to be contracted anew: sorted edges are shared, they never change."""
        other = copy.copy(self)
        other.size, other.inner = self.size.copy(), self.inner.copy()
        return other

    def _first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each component's cheapest of the given edges."""
        first = np.full(len(self.size), len(a))
        at = np.arange(len(a))[::-1]
        first[a[::-1]] = at
        other = np.full(len(self.size), len(a))
        other[b[::-1]] = at
        return np.minimum(first, other)

    def _join(self, keep: np.ndarray, lose: np.ndarray) -> None:
        """Hooks each of ``lose`` (distinct) onto its ``keep``; chains and pairs collapse."""
        to = np.arange(len(self.size))
        to[lose] = keep
        pair = to[to[lose]] == lose
        mutual = lose[pair & (lose < to[lose])]
        to[mutual] = mutual
        while (to[to] != to).any():
            to = to[to]
        self.root = to[self.root]
        gone = np.flatnonzero(to != np.arange(len(to)))
        np.add.at(self.size, to[gone], self.size[gone])
        np.maximum.at(self.inner, to[gone], self.inner[gone])

    def _edges(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges numbered ``which`` between their present components, without loops."""
        a, b = self.root[self.a[which]], self.root[self.b[which]]
        apart = a != b
        return a[apart], b[apart], which[apart]

    def _cheapest(self, a: np.ndarray, b: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of parallel edges the cheapest."""
        key = np.minimum(a, b) * len(self.size) + np.maximum(a, b)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.sort(order[np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))]) if len(key) else order
        return a[first], b[first], which[first]

    def _reach(self, a: np.ndarray, b: np.ndarray, cost: np.ndarray, tolerance: float) -> np.ndarray:
        """The cost up to which each component's edges are within its tolerance one after the other."""
        comp, other = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel()
        order = np.argsort(comp, kind="stable")
        comp, other, cost = comp[order], other[order], np.repeat(cost, 2)[order]
        first = np.concatenate([[True], comp[1:] != comp[:-1]])
        start = np.flatnonzero(first)
        before = np.concatenate([[0.0], cost[:-1]])
        before[start] = self.inner[comp[start]]
        grown = np.cumsum(self.size[other]) - self.size[other]
        held = self.size[comp] + grown - np.repeat(grown[start], np.diff(np.append(start, len(comp))))
        bad = np.cumsum(cost - before > tolerance / held)
        bad -= np.repeat(bad[start] - (cost[start] - before[start] > tolerance / held[start]), np.diff(np.append(start, len(comp))))
        within = np.add.reduceat(bad == 0, start)
        out = np.full(len(self.size), -1.0)
        some = within > 0
        out[comp[start[some]]] = cost[start[some] + within[some] - 1]
        return out

    def contract(self, tolerance: float) -> None:
        """Join components along edges within both reaches until there are none."""
        a, b, which = self._edges(np.arange(len(self.a)))
        single = bool((self.size == 1).all())  # pixels: the tolerance alone is reach enough
        while len(which):
            cost = self.cost[which]
            reach = np.full(len(self.size), tolerance) if single else self._reach(a, b, cost, tolerance)
            single = False
            open_ = (reach[a] >= cost) & (reach[b] >= cost)
            first = self._first(a[open_], b[open_])
            mine = np.flatnonzero((first < np.count_nonzero(open_)) & ~self.outside)
            edge = np.flatnonzero(open_)[first[mine]]
            to = np.where(a[edge] == mine, b[edge], a[edge])
            free = ~self.outside[to]
            mine, edge, to = mine[free], edge[free], to[free]
            if not len(mine):
                return
            self.inner[mine] = np.maximum(self.inner[mine], cost[edge])
            self._join(to, mine)
            alive = (reach[a] >= 0) & (reach[b] >= 0)
            a, b, which = self._edges(which[alive])
            a, b, which = self._cheapest(a, b, which)

    def absorb(self, least: int) -> None:
        """Components under ``least`` join along their cheapest edge."""
        a, b, which = self._edges(np.arange(len(self.a)))
        while len(which):
            a, b, which = self._cheapest(a, b, which)
            small = self.size < least
            first = self._first(a, b)
            mine = np.flatnonzero(small & (first < len(which)))
            if not len(mine):
                return
            edge = first[mine]
            to = np.where(a[edge] == mine, b[edge], a[edge])
            # a large partner takes all small ones, of two small ones both must want the edge
            sure = ~small[to] | (first[to] == edge)
            self._join(to[sure], mine[sure])
            a, b = self.root[a], self.root[b]
            alive = (a != b) & ((self.size[a] < least) | (self.size[b] < least))
            a, b, which = a[alive], b[alive], which[alive]


def edges(image: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cost) of 8-neighbours of an image with channels; ids number the pixels."""
    h, w = ids.shape
    parts = []
    for dv, du in STEPS:
        p = (slice(0, h - dv), slice(max(0, -du), w - max(0, du)))
        q = (slice(dv, h), slice(max(0, du), w - max(0, -du)))
        parts.append((ids[p].ravel(), ids[q].ravel(), np.sqrt(((image[p] - image[q]) ** 2).sum(axis=2)).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def graph(image: np.ndarray, sigma: float) -> Graph:
    """The pixels of one raster in one piece, none joined yet."""
    image = kernels.smooth(image.astype(float), sigma)
    image = image[..., None] if image.ndim == 2 else image
    n = image.shape[0] * image.shape[1]
    a, b, cost = edges(image, np.arange(n).reshape(image.shape[:2]))
    return Graph(a, b, cost, mark(a, b), np.ones(n, np.int64), np.zeros(n))


def segments(pixels: Graph, shape: tuple[int, int], scale: float, least: int) -> np.ndarray:
    """Labels of a raster's graph, which itself stays as it is."""
    joined = pixels.fresh()
    joined.contract(scale / 255.0)
    joined.absorb(least)
    return joined.root.reshape(shape)


def whole(image: np.ndarray, scale: float, sigma: float, least: int) -> np.ndarray:
    """Labels of one raster in one piece."""
    return segments(graph(image, sigma), image.shape[:2], scale, least)


def _tile(pdf: pd.DataFrame, key: str, channels: list[str], tolerance: float, sigma: float, wide: int) -> pd.DataFrame:
    """What a tile tells: its pixels' components, the components, and the edges between them.

    kind 0: pixel x is in component y (rim: another tile may name the pixel); 1: component
    x of size y and inner cost; 2: edge x to y, across the border between pixels.
    """
    u0, v0 = int(pdf["u"].min()), int(pdf["v"].min())
    u, v = pdf["u"].to_numpy() - u0, pdf["v"].to_numpy() - v0
    shape = (int(v.max()) + 1, int(u.max()) + 1)
    image, mine = np.zeros((*shape, len(channels))), np.zeros(shape, bool)
    image[v, u], mine[v, u] = pdf[channels].to_numpy(float), pdf["mine"]
    image = kernels.smooth(image, sigma)
    name = ((np.arange(shape[0])[:, None] + v0) * wide + np.arange(shape[1]) + u0).ravel()
    there = np.zeros(shape, bool)
    there[v, u] = True
    a, b, cost = edges(image, np.arange(len(name)).reshape(shape))
    inside, there = mine.ravel(), there.ravel()
    used = (inside[a] | inside[b]) & there[a] & there[b]
    a, b, cost = a[used], b[used], cost[used]
    cross = inside[a] & ~inside[b]  # the tile of the first pixel tells an edge that crosses
    graph = Graph(a, b, cost, mark(name[a], name[b]), np.ones(len(name), np.int64), np.zeros(len(name)), ~inside)
    graph.contract(tolerance)
    both = inside[graph.a] & inside[graph.b]
    graph.a, graph.b, graph.cost, graph.order = graph.a[both], graph.b[both], graph.cost[both], graph.order[both]
    pixel = np.flatnonzero(inside)
    comp = np.unique(graph.root[pixel])
    x, y, which = graph._cheapest(*graph._edges(np.arange(len(graph.a))))
    rim = inside & kernels.grow(~mine, cross=False).ravel()
    a, b, cost = a[cross], b[cross], cost[cross]
    parts = [len(pixel), len(comp), len(which), len(a)]
    none = np.zeros(len(pixel), np.int64)
    rows = {
        "kind": np.repeat(np.array([0, 1, 2, 2], np.int8), parts),
        "x": np.concatenate([name[pixel], name[comp], name[x], name[graph.root[a]]]),
        "y": np.concatenate([name[graph.root[pixel]], graph.size[comp], name[y], name[b]]),
        "cost": np.concatenate([none.astype(float), graph.inner[comp], graph.cost[which], cost]),
        "tie": np.concatenate([none, np.zeros(len(comp), np.int64), graph.order[which].astype(np.int64), mark(name[a], name[b]).astype(np.int64)]),
        "across": np.repeat([False, False, False, True], parts),
        "rim": np.concatenate([rim[pixel], np.zeros(sum(parts[1:]), bool)]),
    }
    return pd.DataFrame({key: pdf[key].iloc[0], **rows})


def _seams(pdf: pd.DataFrame, key: str, tolerance: float, least: int) -> pd.DataFrame:
    """(key, comp, label): the components of all tiles of a scan, joined by the same rule."""
    kind, x, y, cost, tie, across = (pdf[c].to_numpy() for c in ("kind", "x", "y", "cost", "tie", "across"))
    row = np.flatnonzero(kind == 1)
    row = row[np.argsort(x[row])]
    comp, size, inner = x[row], y[row], cost[row]
    rim = np.flatnonzero(kind == 0)
    rim = rim[np.argsort(x[rim])]
    e = kind == 2
    end = y[e]
    end[across[e]] = y[rim[np.searchsorted(x[rim], end[across[e]])]]
    graph = Graph(np.searchsorted(comp, x[e]), np.searchsorted(comp, end), cost[e], tie[e].astype(np.uint64), size.astype(np.int64), inner)
    graph.contract(tolerance)
    graph.absorb(least)
    return pd.DataFrame({key: pdf[key].iloc[0], "comp": comp, "label": comp[graph.root]})


def tiled(pixels: DataFrame, channels: list[str], scale: float, sigma: float, least: int, tile: int = TILE, key: str = KEY) -> DataFrame:
    """(key, u, v, label) of dense scans with one or more numeric ``channels``.

    A label is v * 2^20 + u of one of its pixels.  A task holds one tile with the pixels
    that blur into it; the graph of components of a scan is one group.
    """
    wide, tolerance = 1 << 20, scale / 255.0
    halo = 1 + (max(1, int(4 * sigma + 0.5)) if sigma > 0 else 0)
    kind = pixels.schema[key].dataType.simpleString()
    tiles = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    rows = pixels.select(key, "u", "v", *(F.col(c).cast("double").alias(c) for c in channels))
    rows = rows.withColumn("tu", F.explode(tiles("u"))).withColumn("tv", F.explode(tiles("v")))
    rows = rows.withColumn("mine", (F.floor(F.col("u") / tile) == F.col("tu")) & (F.floor(F.col("v") / tile) == F.col("tv")))
    schema = f"{key} {kind}, kind byte, x long, y long, cost double, tie long, across boolean, rim boolean"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["mine"].any():
            return pd.DataFrame(columns=[key, "kind", "x", "y", "cost", "tie", "across", "rim"])
        return _tile(pdf, key, channels, tolerance, sigma, wide)

    told = save(rows.groupBy(key, "tu", "tv").applyInPandas(solve, schema), "tiles")
    graph = told.filter("kind > 0 or rim").drop("rim")
    labels = save(graph.groupBy(key).applyInPandas(lambda pdf: _seams(pdf, key, tolerance, least), f"{key} {kind}, comp long, label long"), "seams")
    pixel = told.filter("kind = 0").select(key, (F.col("x") % wide).cast("int").alias("u"), F.floor(F.col("x") / wide).cast("int").alias("v"), F.col("y").alias("comp"))
    return pixel.join(labels, [key, "comp"]).select(key, "u", "v", "label")


def _named(found: DataFrame, pixels: DataFrame, merge: float | None, key: str) -> DataFrame:
    """Labels inside the room from 0 on, those of near mean heights joined if wanted; -1 outside."""
    held = found.join(pixels.select(key, "u", "v", "y", "in_room"), [key, "u", "v"]).withColumn("label", F.when(F.col("in_room"), F.col("label")))
    if merge is not None:
        held = save(held, "held")
        to = raster.merge_by_height(held, "y", merge, "label", key)
        held = held.join(to, [key, "label"], "left").withColumn("label", F.col("merged")).drop("merged")
    return raster.compact(held, "label", key).select(key, "u", "v", F.coalesce("compact", F.lit(-1)).alias("label"))


def _heights(pixels: DataFrame, key: str) -> DataFrame:
    """``pixels`` with ``height``: y, or the scan's median where nothing was seen."""
    middle = pixels.groupBy(key).agg(F.coalesce(F.median("y"), F.lit(0.0)).alias("middle"))
    return pixels.join(middle, key).withColumn("height", F.coalesce("y", "middle")).drop("middle")


def _least(ppm: float) -> int:
    return int(0.3 * ppm**2)


def felzenszwalb(pixels: DataFrame, ppm: float, scale: float = 200, sigma: float = 0.8, merge: float | None = None, tile: int = TILE, key: str = KEY) -> DataFrame:
    """(key, u, v, label) of pixels (y, in_room) by their heights, over tiles."""
    return _named(tiled(_heights(pixels, key), ["height"], scale, sigma, _least(ppm), tile, key), pixels, merge, key)


def felzenszwalb_image(pixels: DataFrame, ppm: float, scale: float = 200, sigma: float = 0.8, merge: float | None = 0.03, tile: int = TILE, key: str = KEY) -> DataFrame:
    """(key, u, v, label) of pixels (y, in_room, r, g, b) by their colours, over tiles."""
    rows = pixels.withColumns({c: F.col(c) / 255.0 for c in "rgb"})
    return _named(tiled(rows, ["r", "g", "b"], scale, sigma, _least(ppm), tile, key), pixels, merge, key)


def felzenszwalb_combined(pixels: DataFrame, ppm: float, scale: float = 200, sigma: float = 0.8, height_weight: float = 1.0, intensity_weight: float = 0.3, tile: int = TILE, key: str = KEY) -> DataFrame:
    """(key, u, v, label) of pixels by height, from 0 to 1 over the scan, and grey, over tiles."""
    rows = _heights(pixels, key)
    ends = rows.groupBy(key).agg(F.min("height").alias("low"), F.greatest(F.max("height") - F.min("height"), F.lit(1e-6)).alias("range"))
    gray = F.bround(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))
    rows = rows.join(ends, key).withColumns({"height": height_weight * (F.col("height") - F.col("low")) / F.col("range"), "gray": intensity_weight * gray / 255.0})
    return _named(tiled(rows, ["height", "gray"], scale, sigma, _least(ppm), tile, key), pixels, None, key)

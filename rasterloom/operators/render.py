"""Textured top-down renders of triangle meshes, and overlays of regions.

Each face carries the affine map from plan pixels to texels.  The z-buffer picks one face
a pixel first, so that only visible pixels meet the texel table; a pixel's colour is the
weighted sum of four texels, joined by their place in the texture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import mesh

CHANNELS = "rgb"


def uv_corners(faces: DataFrame, uvs: DataFrame) -> DataFrame:
    """``faces`` (key, t array<bigint>) plus tp, tq, tr structs of u, v.

    Faces with an index that ``uvs`` (key, tid, u, v) lacks drop out.
    """
    out = faces
    for k, name in enumerate("pqr"):
        side = uvs.select(F.col("key").alias("__key"), F.col("tid").alias("__tid"), F.struct("u", "v").alias(f"t{name}"))
        out = out.join(side, (F.col("key") == F.col("__key")) & (F.element_at("t", k + 1) == F.col("__tid"))).drop("__key", "__tid")
    return out


def renderable(faces: DataFrame, materials: DataFrame, ppm: float) -> DataFrame:
    """Faces whose material is known, whose plan triangle has an area and meets the grid.

    ``faces``: key, mat, p, q, r, tp, tq, tr and their grid (max_x, max_z, width, height);
    ``materials``: key, mat, tw, th, the texture's size (null where the file is missing).
    Adds tw, th and the map from plan pixels (u, v) to texels: sx = s0 + su * u + sv * v,
    and sy alike.
    """
    rows = faces.join(materials, ["key", "mat"])
    wide = {name: F.struct(((F.col("max_x") - F.col(f"{name}.x")) * ppm).alias("u"), ((F.col("max_z") - F.col(f"{name}.z")) * ppm).alias("v")) for name in "pqr"}
    rows = rows.withColumns({f"__{name}": at for name, at in wide.items()})
    side = lambda name, c: F.col(f"__{name}.{c}") - F.col(f"__p.{c}")
    rows = rows.withColumn("__det", side("q", "u") * side("r", "v") - side("r", "u") * side("q", "v")).filter(F.col("__det") != 0)
    size = {"u": F.coalesce("tw", F.lit(1)), "v": F.coalesce("th", F.lit(1))}

    def source(name: str, c: str) -> Column:
        t = F.col(f"t{name}.{c}")
        return (t if c == "u" else 1 - t) * size[c]

    for c, axis in (("u", "x"), ("v", "y")):
        dq, dr = source("q", c) - source("p", c), source("r", c) - source("p", c)
        du = (dq * side("r", "v") - dr * side("q", "v")) / F.col("__det")
        dv = (dr * side("q", "u") - dq * side("r", "u")) / F.col("__det")
        rows = rows.withColumns({f"s{axis}u": du, f"s{axis}v": dv, f"s{axis}0": source("p", c) - du * F.col("__p.u") - dv * F.col("__p.v")})
    for c, most in (("u", "width"), ("v", "height")):
        corner = [F.col(f"__{name}.{c}") for name in "pqr"]
        rows = rows.filter((F.floor(F.least(*corner)) < F.col(most)) & (F.ceil(F.greatest(*corner)) + 1 > 0))
    return rows.drop("__p", "__q", "__r", "__det")


AFFINE = ["sx0", "sxu", "sxv", "sy0", "syu", "syv"]


def visible(faces: DataFrame, ppm: float, order: str = "fid") -> DataFrame:
    """(key, u, v, y, order, mat, tw, th, affine map): the lowest face at each pixel of the grid, by its mean height."""
    rows = faces.withColumn("y", (F.col("p.y") + F.col("q.y") + F.col("r.y")) / 3)
    px = mesh.rasterize(rows, F.col("max_x"), F.col("max_z"), ppm).filter("u >= 0 and v >= 0 and u < width and v < height")
    return mesh.z_buffer(px, ["key", "u", "v"], "y", order, ["mat", "tw", "th", *AFFINE])


def reflected(at: Column, size: Column) -> Column:
    """A place beyond 0 to size - 1 mirrored back, the border itself twice."""
    turn = F.pmod(at, 2 * size)
    return F.when(turn < size, turn).otherwise(2 * size - 1 - turn)


def sampled(pixels: DataFrame, texels: DataFrame) -> DataFrame:
    """Adds r, g, b of ``visible`` pixels, bilinear in ``texels`` (key, mat, tu, tv, r, g, b).

    Black where the texture or a texel is missing; halves round up.
    """
    rows = pixels.withColumns({f"__{c}": F.col(f"s{c}0") + F.col(f"s{c}u") * F.col("u") + F.col(f"s{c}v") * F.col("v") for c in "xy"})
    rows = rows.withColumns({f"__{c}0": F.floor(f"__{c}") for c in "xy"}).drop(*AFFINE)
    far = {c: F.col(f"__{c}") - F.col(f"__{c}0") for c in "xy"}
    part = lambda i, j: (far["x"] if i else 1 - far["x"]) * (far["y"] if j else 1 - far["y"])
    place = lambda c, d, size: reflected(F.col(f"__{c}0") + d, F.col(size).cast("long")).cast("int")
    four = F.array(*(F.struct(place("x", i, "tw").alias("tu"), place("y", j, "th").alias("tv"), part(i, j).alias("w")) for i in (0, 1) for j in (0, 1)))
    held = [c for c in pixels.columns if c not in AFFINE]
    each = rows.select(*held, F.explode(F.when(F.col("tw").isNotNull(), F.filter(four, lambda x: x["w"] > 0)).otherwise(F.slice(four, 1, 1))).alias("__t"))
    each = each.select(*held, F.col("__t.tu").alias("tu"), F.col("__t.tv").alias("tv"), F.col("__t.w").alias("__w"))
    met = each.join(texels.select("key", "mat", "tu", "tv", *CHANNELS), ["key", "mat", "tu", "tv"], "left")
    colours = [F.floor(F.sum(F.coalesce(F.col("__w") * F.col(c), F.lit(0.0))) + 0.5).cast("int").alias(c) for c in CHANNELS]
    others = [F.first(c).alias(c) for c in held if c not in ("key", "u", "v")]
    return met.groupBy("key", "u", "v").agg(*others, *colours)


def textured(faces: DataFrame, materials: DataFrame, texels: DataFrame, ppm: float, order: str = "fid") -> DataFrame:
    """(key, u, v, y, order, r, g, b): colour and height of the lowest face at each pixel."""
    seen = visible(renderable(faces, materials, ppm), ppm, order)
    return sampled(seen, texels).select("key", "u", "v", "y", order, *CHANNELS)


def overlay(base: DataFrame, layers: DataFrame, keys: tuple[str, ...] = ("session_id", "u", "v")) -> DataFrame:
    """``base`` (keys, r, g, b) under ``layers`` (keys, layer, r, g, b, alpha) in ascending order.

    Ordered "over" as an aggregate: a layer's share is its alpha times what all higher ones
    let through, so that the layers of a pixel need no sequence of joins.  Halves round up.
    """
    shares = F.array_sort(F.collect_list(F.struct("layer", "r", "g", "b", "alpha")))
    above = layers.groupBy(*keys).agg(shares.alias("__l"))
    rows = base.join(above, list(keys), "left")

    def blend(c: str) -> Column:
        over = lambda acc, x: acc * (1 - x["alpha"]) + x[c] * x["alpha"]
        return F.floor(F.aggregate(F.coalesce("__l", F.array().cast(rows.schema["__l"].dataType)), F.col(c).cast("double"), over) + 0.5).cast("int")

    return rows.withColumns({c: blend(c) for c in CHANNELS}).drop("__l")


def coverage(labels: DataFrame, room: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, label, n, mean_u, mean_v, percent): each region's pixels, mean pixel and share of the room.

    ``labels``: key, u, v, label (negative: none); label -1 of the result stands for all regions together.
    """
    inside = labels.filter("label >= 0").join(room.select(key, "u", "v"), [key, "u", "v"], "left_semi")
    total = room.groupBy(key).agg(F.count("*").alias("total"))
    each = inside.select(key, "u", "v", F.explode(F.array(F.col("label"), F.lit(-1))).alias("label"))
    found = each.groupBy(key, "label").agg(F.count("*").alias("n"), F.avg("u").alias("mean_u"), F.avg("v").alias("mean_v"))
    return found.join(total, key).withColumn("percent", 100 * F.col("n") / F.col("total")).drop("total")

"""Triangle meshes as tables: gathers, face geometry, selection, rasters and z-buffer.

Faces carry their three corners as ``p``, ``q``, ``r`` structs of x, y, z.  Normals and
areas are arithmetic on one row; a raster generates only each triangle's own spans;
the z-buffer is one group-by with map-side minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """``faces`` (v array<bigint>) plus p, q, r from ``vertices`` (vid, x, y, z)."""
    out = faces
    for k, name in enumerate("pqr"):
        side = vertices.select(F.col("vid").alias(f"__{name}"), F.struct("x", "y", "z").alias(name))
        out = out.join(side, F.element_at("v", k + 1) == F.col(f"__{name}")).drop(f"__{name}")
    return out


def fan(faces: DataFrame, polygon: str = "polygon") -> DataFrame:
    """n-gons (array of vertex ids) as triangles (0, i, i + 1), numbered by ``part``."""
    p = F.col(polygon)
    rows = faces.filter(F.size(p) >= 3).withColumn("part", F.explode(F.sequence(F.lit(1), F.size(p) - 2)))
    return rows.withColumn("v", F.array(F.element_at(p, 1), F.element_at(p, F.col("part") + 1), F.element_at(p, F.col("part") + 2)))


def align(vertices: DataFrame, inverse: list[float]) -> DataFrame:
    """Vertices through a row-major 3 x 4 affine map."""
    rows = [inverse[i : i + 4] for i in (0, 4, 8)]
    new = [r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3] for r in rows]
    return vertices.withColumns(dict(zip("xyz", new, strict=True)))


def _cross() -> tuple[Column, Column, Column]:
    a = {c: F.col(f"q.{c}") - F.col(f"p.{c}") for c in "xyz"}
    b = {c: F.col(f"r.{c}") - F.col(f"p.{c}") for c in "xyz"}
    return a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]


def geometry(faces: DataFrame) -> DataFrame:
    """Adds unit normal nx, ny, nz (0 for no area), area, and centroid cx, cy, cz."""
    x, y, z = _cross()
    size = F.sqrt(x * x + y * y + z * z)
    safe = F.when(size == 0, F.lit(1.0)).otherwise(size)
    out = faces.withColumns({"nx": x / safe, "ny": y / safe, "nz": z / safe, "area": size / 2})
    return out.withColumns({f"c{c}": (F.col(f"p.{c}") + F.col(f"q.{c}") + F.col(f"r.{c}")) / 3 for c in "xyz"})


def downward(faces: DataFrame, max_tilt: float = 30.0) -> DataFrame:
    """Faces (with geometry) that look down within a tilt in degrees."""
    return faces.filter(F.col("ny") < -F.cos(F.radians(F.lit(max_tilt))))


def wall_edges(faces: DataFrame, ceiling: Column, max_tilt: float = 15.0, span: float = 0.6, near: float = 0.8) -> DataFrame:
    """Upright faces of little height near the ceiling height."""
    ys = [F.col(f"{c}.y") for c in "pqr"]
    upright = F.abs("ny") < F.sin(F.radians(F.lit(max_tilt)))
    return faces.filter(upright & (F.greatest(*ys) - F.least(*ys) < span) & (F.least(*(F.abs(y - ceiling) for y in ys)) < near))


def counts(vertices: DataFrame, faces: DataFrame, key: str = "file") -> DataFrame:
    """(key, n_verts, n_tris) of meshes that have either."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    return n(vertices, "n_verts").join(n(faces, "n_tris"), key, "full").fillna(0, ["n_verts", "n_tris"])


def y_range(faces: DataFrame) -> DataFrame:
    """One row: the least and greatest height of the corners used."""
    return faces.agg(F.min(F.least("p.y", "q.y", "r.y")).alias("min_y"), F.max(F.greatest("p.y", "q.y", "r.y")).alias("max_y"))


def grid(faces: DataFrame, ppm: float, pad: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one per mesh: the padded extent of the corners used, and the size in pixels."""
    low = {c: F.min(F.least(*(F.col(f"{k}.{c}") for k in "pqr"))) - pad for c in "xz"}
    high = {c: F.max(F.greatest(*(F.col(f"{k}.{c}") for k in "pqr"))) + pad for c in "xz"}
    row = faces.groupBy(*by).agg(low["x"].alias("min_x"), high["x"].alias("max_x"), low["z"].alias("min_z"), high["z"].alias("max_z"))
    size = {"width": F.ceil((F.col("max_x") - F.col("min_x")) * ppm).cast("int"), "height": F.ceil((F.col("max_z") - F.col("min_z")) * ppm).cast("int")}
    return row.withColumns({"pixels_per_metre": F.lit(float(ppm))} | size)


def rasterize(faces: DataFrame, max_x: Column, max_z: Column, ppm: float) -> DataFrame:
    """Adds (u, v): the pixels of each triangle; corners are truncated to whole pixels.

    Interior by scanlines plus edge pixels, so overlapping triangles form a union.
    """
    from rasterloom.operators.raster import fill_polygons

    corner = [F.struct(((max_x - F.col(f"{k}.x")) * ppm).cast("int").alias("u"), ((max_z - F.col(f"{k}.z")) * ppm).cast("int").alias("v")) for k in "pqr"]
    return fill_polygons(faces.withColumn("__tri", F.array(*corner)), "__tri").drop("__tri")


def wall_raster(faces: DataFrame, ceiling: Column, ppm: float, key: str, dilate_px: int = 1) -> DataFrame:
    """(key, u, v): wall edges near the ceiling burnt into their mesh's grid and widened by a square.

    ``faces`` with geometry and the columns of their grid.
    """
    from rasterloom.operators.raster import dilate

    steps = range(-dilate_px, dilate_px + 1)
    px = rasterize(wall_edges(faces, ceiling).select(key, "width", "height", "max_x", "max_z", "p", "q", "r"), F.col("max_x"), F.col("max_z"), ppm)
    size = faces.select(key, "width", "height").distinct()
    wide = dilate(px.select(key, "u", "v").distinct(), [(a, b) for a in steps for b in steps], key)
    return wide.join(size, key).filter("u >= 0 and v >= 0 and u < width and v < height").select(key, "u", "v")


def z_buffer(pixels: DataFrame, keys: list[str], height: str, order: str, values: list[str]) -> DataFrame:
    """The lowest face (in float32) at each pixel, the first in order on ties."""
    least = F.min(F.struct(F.col(height).cast("float").alias(height), *([order] if order else []), *values)).alias("least")
    return pixels.groupBy(*keys).agg(least).select(*keys, "least.*")


def texture(pixels: DataFrame, texels: DataFrame, keys: list[str]) -> DataFrame:
    """Colours of (tu, tv) from a texel table; black where the texture is missing."""
    colours = {c: F.coalesce(c, F.lit(0)) for c in "rgb"}
    return pixels.join(texels, keys, "left").withColumns(colours)

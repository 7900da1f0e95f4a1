"""Stored sessions as DataFrames: plan and truth documents, cached rasters, whole scans.

A session lies in ``<root>/<session>/out`` with ``plan.json``, ``height.npy``, an image
``ceiling.jpg`` and perhaps ``wall_edges.npy``.  Paths may hold wildcards, so one call
reads many sessions; a path without files is an error of Spark's reader.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import raster
from rasterloom.sources import scans

KEY = "session_id"
GRID = "struct<min_x double, max_x double, min_z double, max_z double, pixels_per_metre double, width int, height int>"
POLYGON = "array<array<double>>"
STATS = "struct<mean_y double, std_y double, valid_frac double, min_y double, max_y double, n_valid_px bigint, n_total_px bigint>"
#: Plan documents; truth documents are the same without the statistics.
PLAN = (
    f"session_id string, name string, grid {GRID}, room {POLYGON}, main struct<polygon {POLYGON}, label string, notes string, stats {STATS}>, "
    f"regions array<struct<id bigint, polygon {POLYGON}, label string, notes string, relative_y double, stats {STATS}>>"
)
#: Lines of a raster in one batch.
LINES = 64


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per plan or truth document; fields that it lacks are null."""
    return spark.read.schema(PLAN).json(path, multiLine=True)


def _points(polygon: Column) -> Column:
    return F.transform(polygon, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("z")))


def polygons(docs: DataFrame) -> DataFrame:
    """(session_id, kind, id, label, notes, polygon, mean_y, position): rooms, mains and regions.

    ``position`` is null for rooms, 0 for mains and counts regions from 1 in stored order.
    """
    none = F.lit(None)

    def row(kind: str, id_: Column, label: Column, notes: Column, polygon: Column, mean: Column, position: Column) -> list[Column]:
        made = {"kind": F.lit(kind), "id": id_.cast("bigint"), "label": label.cast("string"), "notes": F.coalesce(notes.cast("string"), F.lit("")), "polygon": _points(polygon)}
        return [F.col(KEY), *(c.alias(n) for n, c in made.items()), mean.cast("double").alias("mean_y"), position.cast("int").alias("position")]

    rooms = docs.filter("room is not null").select(row("room", none, none, none, F.col("room"), none, none))
    mains = docs.filter("main is not null").select(row("main", none, F.col("main.label"), F.col("main.notes"), F.col("main.polygon"), F.col("main.stats.mean_y"), F.lit(0)))
    each = docs.select(KEY, F.posexplode("regions").alias("at", "r"))
    regions = each.select(row("region", F.col("r.id"), F.col("r.label"), F.col("r.notes"), F.col("r.polygon"), F.col("r.stats.mean_y"), F.col("at") + 1))
    return rooms.unionByName(mains).unionByName(regions)


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """(file, u, v, value): every pixel of two-dimensional ``.npy`` files; null where not finite."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                values = np.load(io.BytesIO(content), allow_pickle=False)
                for v in range(0, values.shape[0], LINES):
                    block = values[v : v + LINES].astype(np.float64)
                    at = np.indices(block.shape).reshape(2, -1)
                    flat = pd.array(np.where(np.isfinite(block), block, 0).ravel(), "Float64")
                    flat[~np.isfinite(block).ravel()] = pd.NA
                    yield pd.DataFrame({"file": file, "u": at[1], "v": at[0] + v, "value": flat})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, "file string, u int, v int, value double")


def session_of(file: Column) -> Column:
    """The session in the path of a file of its ``out`` folder."""
    return F.element_at(F.split(file, "/"), -3)


def pixel_polygon(polygon: Column) -> Column:
    """A polygon in whole pixels of the columns max_x, max_z and pixels_per_metre; places are truncated."""
    ppm = F.col("pixels_per_metre")
    return F.transform(polygon, lambda p: F.struct(((F.col("max_x") - p["x"]) * ppm).cast("int").alias("u"), ((F.col("max_z") - p["z"]) * ppm).cast("int").alias("v")))


def masks(rows: DataFrame, grids: DataFrame) -> DataFrame:
    """(session_id, position, u, v): the pixels of polygons that lie on their session's grid."""
    both = rows.select(KEY, "position", "polygon").join(grids, KEY)
    px = raster.fill_polygons(both.withColumn("poly", pixel_polygon(F.col("polygon"))).select(KEY, "position", "width", "height", "poly"))
    return px.filter("u >= 0 and v >= 0 and u < width and v < height").select(KEY, "position", "u", "v")


def grids(docs: DataFrame) -> DataFrame:
    return docs.select(KEY, "grid.*")


def truth_labels(docs: DataFrame) -> DataFrame:
    """(session_id, u, v, label) of truth documents: main 0, regions from 1 on, later ones win."""
    rows = polygons(docs).filter("kind <> 'room'")
    won = raster.last_wins(masks(rows, grids(docs)), "position", (KEY, "u", "v"))
    return won.withColumnRenamed("position", "label")


def height_maps(spark: SparkSession, root: str, session: str = "*") -> DataFrame:
    """(session_id, u, v, y): cached height rasters."""
    px = rasters(spark, f"{root}/{session}/out/height.npy")
    return px.select(session_of(F.col("file")).alias(KEY), "u", "v", F.col("value").alias("y"))


def load_scans(spark: SparkSession, root: str, session: str = "*", walls: DataFrame | None = None) -> DataFrame:
    """The pixel table (session_id, u, v, y, in_room, is_wall, r, g, b) that segmentation takes.

    The room is that of the plan; without one, where a height is.  ``walls``
    (session_id, u, v) replace the cached wall rasters, as when they are built anew.
    """
    docs = documents(spark, f"{root}/{session}/out/plan.json")
    rooms = polygons(docs).filter("kind = 'room'").withColumn("position", F.lit(0))
    inside = masks(rooms, grids(docs)).select(KEY, "u", "v").withColumn("inside", F.lit(True))
    if walls is None:
        cached = rasters(spark, f"{root}/{session}/out/wall_edges.npy").filter("value <> 0")
        walls = cached.select(session_of(F.col("file")).alias(KEY), "u", "v")
    canvas = scans.images(spark, f"{root}/{session}/out/ceiling.jpg")
    canvas = canvas.select(session_of(F.col("file")).alias(KEY), F.col("tu").alias("u"), F.col("tv").alias("v"), "r", "g", "b")
    out = height_maps(spark, root, session).join(rooms.select(KEY, F.lit(True).alias("drawn")), KEY, "left")
    for side in (inside, walls.select(KEY, "u", "v").distinct().withColumn("wall", F.lit(True)), canvas):
        out = out.join(side, [KEY, "u", "v"], "left")
    no, black = F.lit(False), F.lit(0).cast("smallint")
    room = F.when(F.col("drawn"), F.coalesce("inside", no)).otherwise(F.col("y").isNotNull())
    return out.select(KEY, "u", "v", "y", room.alias("in_room"), F.coalesce("wall", no).alias("is_wall"), *(F.coalesce(c, black).alias(c) for c in "rgb"))

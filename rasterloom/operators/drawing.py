"""The tables that a plan's sheet is drawn from: shapes, their texts, dimensions, page.

Plans are rows as in ``documents``.  A plan without a room has no sheet.  Sheets show x
from right to left, so that a plan reads as seen from above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import labels
from rasterloom.operators import compose, documents

KEY = "session_id"
#: Edges of the main, of regions and of the room; width of a page (in).
MAIN_EDGE, REGION_EDGE, ROOM_EDGE, PAGE = "#00897b", "#444", "#222", 11.0
#: Fixed value: what a sheet's title begins with.
TITLE = "Reflected Ceiling Plan — session "


def _sheets(plan: DataFrame) -> DataFrame:
    return plan.filter("kind = 'room' and size(polygon) > 0").select(KEY).distinct()


def marks(plan: DataFrame) -> DataFrame:
    """(session_id, layer, item, text, x, z, angle, face, edge, polygon): what a sheet shows, from the bottom up.

    ``shape``: the main (item null) and the regions (by id) with name, height and notes at
    their vertices' mean; ``room``: the outline; ``dimension``: the length of each of its
    edges (item) of at least a millimetre, outside and along it.
    """
    rows = documents.with_relative(plan.join(_sheets(plan), KEY, "left_semi"))
    main = F.col("kind") == "main"
    name = F.coalesce("label", F.when(main, F.lit("Main Ceiling (1)")).otherwise(F.concat(F.lit("region "), F.col("id").cast("string"))))
    said = F.concat_ws("\n", name, "tag", F.when(F.col("notes") != "", F.col("notes")))
    item = F.when(~main, F.col("id").cast("long"))
    face = F.when(main, F.lit(compose.MAIN)).otherwise(labels.tint(F.col("id"), compose.PALETTE))
    shapes = rows.filter("kind in ('main', 'region') and size(polygon) > 0").withColumn("at", geo.vertex_mean("polygon"))
    edge = F.when(main, F.lit(MAIN_EDGE)).otherwise(F.lit(REGION_EDGE))
    shapes = shapes.select(KEY, F.lit("shape").alias("layer"), item.alias("item"), said.alias("text"), "at.x", "at.z", F.lit(0.0).alias("angle"), face.alias("face"), edge.alias("edge"), "polygon")
    rooms = rows.filter("kind = 'room'").withColumn("edge", F.lit(ROOM_EDGE))
    outlines = rooms.select(KEY, F.lit("room").alias("layer"), "edge", "polygon")
    sizes = rooms.withColumn("d", F.explode(geo.dimensions("polygon")))
    text = F.concat(F.col("d.length_mm").cast("string"), F.lit(" mm"))
    sizes = sizes.select(KEY, F.lit("dimension").alias("layer"), F.col("d.i").cast("long").alias("item"), text.alias("text"), "d.x", "d.z", "d.angle", "edge")
    return shapes.unionByName(outlines, allowMissingColumns=True).unionByName(sizes, allowMissingColumns=True)


def pages(plan: DataFrame) -> DataFrame:
    """(session_id, title, min_x, max_x, min_z, max_z, page_width, page_height): the sheet of each plan with a room."""
    rooms = plan.filter("kind = 'room' and size(polygon) > 0").select(KEY, geo.extent("polygon").alias("e"))
    title = F.concat(F.lit(TITLE), F.col(KEY).cast("string"))
    return rooms.select(KEY, title.alias("title"), "e.min_x", "e.max_x", "e.min_z", "e.max_z", F.lit(PAGE).alias("page_width"), "e.page_height")

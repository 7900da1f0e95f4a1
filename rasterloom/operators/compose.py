"""Plans from heights: detection and snapping, with outlines, statistics and problems.

Both work on any number of scans at once and give plan rows, so that a bad scan is a row
with a ``problem`` and doesn't fail the others.  ``pixels`` has one row for each pixel of
a scan's grid: key, u, v, y (metres, null where nothing was seen) and in_room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import labels
from rasterloom.operators import heights, outline, raster, segment
from rasterloom.storage import save

KEY = "session_id"
#: Bin, peak distance and closing of detection (m), least heights of a room, least pixels of a region.
BIN, APART, CLOSE, SEEN, LEAST_PX = 0.005, 0.10, 0.06, 1000, 50
#: Tolerance of snapped outlines (m).
SNAPPED = 0.05
#: The main's tint and those of regions, by id.
MAIN = "#80cbc4"
PALETTE = ["#ff7043", "#9c27b0", "#ffeb3b", "#03a9f4", "#e91e63", "#cddc39", "#3f51b5", "#ff9800", "#009688", "#f44336"]
STATS = ["mean_y", "std_y", "min_y", "max_y", "n_valid", "n_total", "valid_frac"]
#: What is said of scans without a plan.
NO_ROOM, UNSEEN, NONE_LEFT, NO_MAIN, MAIN_LOST = "no pixel lies in the room", "too few heights in the room", "no region is large and covered enough", "the plan has no main ceiling", "the main ceiling has no outline after snapping"


def odd(metres: float, ppm: float) -> int:
    """An odd kernel size of at least three pixels."""
    return max(3, round(metres * ppm) | 1)


def _problems(scans: DataFrame, known: list[tuple[Column, str]], key: str) -> DataFrame:
    said = F.coalesce(*(F.when(cond, F.lit(text)) for cond, text in known), F.lit(None).cast("string"))
    return scans.select(key, said.alias("problem")).filter("problem is not null")


def _rows(shapes: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    """Plan rows of ``shapes`` (key, region, id, label, notes, polygon) with statistics; region 0 is the main."""
    rows = shapes.join(measured, [key, "region"], "left")
    datum = rows.filter("region = 0").select(key, F.col("mean_y").alias("datum"))
    main = F.col("region") == 0
    tint = F.when(main, F.lit(MAIN)).otherwise(labels.tint(F.col("id"), PALETTE))
    rows = rows.join(datum, key, "left").withColumns({"kind": F.when(main, F.lit("main")).otherwise(F.lit("region")), "tint": tint, "relative_y": F.when(~main, F.col("mean_y") - F.col("datum"))})
    rows = rows.withColumn("warnings", labels.warnings(F.col("std_y"), F.col("valid_frac")))
    return rows.select(key, "kind", "id", "label", "notes", "polygon", "tint", "relative_y", *STATS, "warnings", F.lit(None).cast("string").alias("problem"))


def _with_problems(rows: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    told = problems.select(key, F.lit("problem").alias("kind"), "problem")
    return rows.unionByName(told, allowMissingColumns=True)


def detect(
    pixels: DataFrame, grid: DataFrame, ppm: float, most: int = 5, least_m2: float = 0.3, least_edge: float = 0.5, median_m: float = 0.10, least_cover: float = 0.4, band_m: float = 0.10, least_seen: int = SEEN, key: str = KEY
) -> DataFrame:
    """Plan rows (key, kind, id, label, notes, polygon, tint, relative_y, statistics, warnings, problem).

    The main is the region of most pixels; the others get ids from 0 by the height of their
    plane, larger ones first on ties.  Regions are closed before they are outlined, edges
    shorter than ``least_edge`` go, and regions without an outline drop out.  Statistics are
    of the heights within ``band_m`` of the region's plane, counted against all its pixels.
    """
    room = save(pixels.filter("in_room").select(key, "u", "v", "y"), "room")
    counts = pixels.groupBy(key).agg(F.count_if("in_room").alias("room"), F.count(F.when(F.col("in_room"), F.col("y"))).alias("seen"))
    counts = save(counts, "counts")
    good = pixels.select(key, "u", "v", "y", "in_room").join(counts.filter(F.col("seen") >= least_seen).select(key), key, "left_semi")
    marked, found = segment.detected(good, "y", BIN, APART, odd(median_m, ppm), max(LEAST_PX, int(least_m2 * ppm * ppm)), least_cover, most, key)
    marked = save(marked, "regions")

    closed = raster.close(marked.withColumn("mask", F.to_json(F.struct(key, "region"))).select("mask", "u", "v"), raster.disc(odd(CLOSE, ppm) // 2), "mask")
    shapes = outline.largest(outline.rings(closed, ["mask"]), ["mask"], max(2.0, least_edge * ppm))
    names = marked.groupBy(key, "region").agg(F.count("*").alias("area"), F.first("plane").alias("peak")).withColumn("mask", F.to_json(F.struct(key, "region")))
    shapes = shapes.join(names, "mask").join(grid.select(key, "max_x", "max_z"), key)
    world = outline.to_world(F.col("points"), F.col("max_x"), F.col("max_z"), ppm)
    shapes = shapes.withColumn("polygon", geo.long_edges(world, max(2.0, least_edge * ppm) / ppm)).filter(F.size("polygon") >= 3)
    shapes = shapes.join(found.select(key, "peak", F.col("y").alias("plane_y")), [key, "peak"])

    # a region without an outline is no candidate for the main either
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("area"), "region")) == 1
    shapes = save(shapes.withColumn("main", first), "shapes")
    by_height = F.row_number().over(Window.partitionBy(key, "main").orderBy("plane_y", F.desc("area"), "region")) - 1
    named = shapes.withColumn("id", F.when(~F.col("main"), by_height.cast("long")))
    label = F.when(F.col("main"), F.lit("Main Ceiling (1)")).otherwise(F.concat(F.lit("Ceiling Region ("), (F.col("id") + 2).cast("string"), F.lit(")")))
    named = save(named.select(key, F.col("region").alias("old"), F.when(F.col("main"), F.lit(0)).otherwise(F.col("id") + 1).alias("region"), "id", label.alias("label"), F.lit("").alias("notes"), "polygon", "plane_y"), "named")

    seen = marked.withColumnRenamed("region", "old").join(named.select(key, "old", "region", "plane_y"), [key, "old"]).join(room.hint("merge"), [key, "u", "v"])
    measured = heights.band_stats(seen, [key, "region"], "y", F.col("plane_y"), band_m, 9)
    some = counts.join(named.select(key).distinct().withColumn("some", F.lit(True)), key, "left")
    problems = _problems(some, [(F.col("room") == 0, NO_ROOM), (F.col("seen") < least_seen, UNSEEN), (F.col("some").isNull(), NONE_LEFT)], key)
    return _with_problems(_rows(named.drop("old", "plane_y"), measured, key), problems, key)


def masks(polygons: DataFrame, grid: DataFrame, ppm: float, key: str = KEY) -> DataFrame:
    """(key, region, u, v): the pixels of polygons (key, region, polygon) in metres; corners are truncated to whole pixels."""
    at = F.transform("polygon", lambda p: F.struct(((F.col("max_x") - p["x"]) * ppm).cast("int").alias("u"), ((F.col("max_z") - p["z"]) * ppm).cast("int").alias("v")))
    placed = polygons.join(grid.select(key, "max_x", "max_z"), key).select(key, "region", at.alias("poly"))
    return raster.fill_polygons(placed.filter(F.size("poly") > 0)).select(key, "region", "u", "v")


def snap(plan: DataFrame, pixels: DataFrame, grid: DataFrame, ppm: float, key: str = KEY) -> DataFrame:
    """Plan rows as of ``detect``: the main and regions of ``plan`` pushed and pulled until they tile the room.

    Regions keep their pixels, later rows of ``plan`` (higher ids) before earlier ones, the
    main what no region takes, gaps go to the nearest.  Each claim is closed twice and
    outlined; ids, labels and notes stay; a region without an outline drops out, a main
    without one is a problem.  Statistics are those of the new polygons.
    """
    drawn = plan.filter("kind in ('main', 'region')").withColumn("region", F.when(F.col("kind") == "main", F.lit(0)).otherwise(F.col("id") + 1).cast("long"))
    drawn = save(drawn.select(key, "region", "id", "label", F.coalesce("notes", F.lit("")).alias("notes"), "polygon"), "drawn")
    heights_ = save(pixels.select(key, "u", "v", "y", "in_room"), "heights")
    # polygons reach into the room from outside too
    claimed = segment.snap(masks(drawn, grid, ppm, key), heights_, key).filter("region is not null")
    claimed = claimed.join(heights_.filter("in_room").select(key, "u", "v").hint("merge"), [key, "u", "v"]).withColumn("mask", F.to_json(F.struct(key, "region")))
    claimed = save(claimed, "claimed")
    closed = raster.close(claimed.select("mask", "u", "v"), raster.disc(odd(CLOSE, ppm) // 2), "mask", times=2)
    shapes = outline.largest(outline.rings(closed, ["mask"]), ["mask"], max(1.0, SNAPPED * ppm))
    shapes = shapes.join(claimed.select("mask", key, "region").distinct(), "mask").join(grid.select(key, "max_x", "max_z"), key)
    world = outline.to_world(F.col("points"), F.col("max_x"), F.col("max_z"), ppm)
    snapped = save(shapes.select(key, "region", world.alias("polygon")), "snapped")

    mains = snapped.filter("region = 0").select(key).withColumn("left", F.lit(True))
    counts = heights_.groupBy(key).agg(F.count_if("in_room").alias("room"))
    had = drawn.groupBy(key).agg(F.count_if(F.col("region") == 0).alias("mains"))
    told = counts.join(had, key, "left").join(mains, key, "left")
    problems = _problems(told, [(F.col("room") == 0, NO_ROOM), (F.coalesce("mains", F.lit(0)) == 0, NO_MAIN), (F.col("left").isNull(), MAIN_LOST)], key)
    good = save(snapped.join(mains.select(key), key, "left_semi"), "good")
    seen = masks(good, grid, ppm, key).join(heights_.drop("in_room").hint("merge"), [key, "u", "v"])
    measured = heights.stats(seen, [key, "region"], "y", 9)
    return _with_problems(_rows(drawn.drop("polygon").join(good, [key, "region"]), measured, key), problems, key)

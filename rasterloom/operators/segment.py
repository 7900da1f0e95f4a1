"""Segmentation as grouped functions, and the compositions built on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import heights, kernels, mesh, raster
from rasterloom.storage import save

KEY = "session_id"


def _scan(pdf: pd.DataFrame, ppm: float) -> tuple[kernels.Scan, np.ndarray, np.ndarray]:
    u, v = pdf["u"].to_numpy() - pdf["u"].min(), pdf["v"].to_numpy() - pdf["v"].min()
    shape = (int(v.max()) + 1, int(u.max()) + 1)
    y, room, wall, rgb = np.full(shape, np.nan), np.zeros(shape, bool), np.zeros(shape, bool), np.zeros((*shape, 3))
    y[v, u] = pdf["y"].astype(float)
    room[v, u], wall[v, u] = pdf["in_room"], pdf["is_wall"]
    for k, c in enumerate("rgb"):
        rgb[v, u, k] = pdf[c]
    return kernels.Scan(y, room, wall, rgb, ppm), u, v


def segment(pixels: DataFrame, algorithm: str, ppm: float, key: str = KEY, **kwargs) -> DataFrame:
    """(key, u, v, label) of pixels (y, in_room, is_wall, r, g, b) by a registered algorithm.

    One group per scan; -1 marks pixels without a label.
    """
    if algorithm not in kernels.SEG:
        raise KeyError(f"unknown algorithm {algorithm!r}; known: {', '.join(kernels.SEG)}")
    kind = pixels.schema[key].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        scan, u, v = _scan(pdf, ppm)
        labels = kernels.SEG[algorithm](scan, **kwargs)
        return pd.DataFrame({key: pdf[key], "u": pdf["u"], "v": pdf["v"], "label": labels[v, u]})

    return pixels.groupBy(key).applyInPandas(solve, f"{key} {kind}, u int, v int, label int")


def _dealt(pixels: DataFrame, key: str) -> DataFrame:
    """Scans over as many tasks as a shuffle has: they are few bytes and much work, which coalescing goes by."""
    return pixels.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _known(experiments: list[tuple[str, str, dict]]) -> list[tuple[str, str, dict]]:
    last = {name: (name, algorithm, kwargs) for name, algorithm, kwargs in experiments if algorithm in kernels.SEG}
    return list(last.values())


def sweep(pixels: DataFrame, experiments: list[tuple[str, str, dict]], ppm: float, key: str = KEY) -> DataFrame:
    """(key, name, u, v, label) for every scan and (name, algorithm, arguments), unknown ones left out.

    Scans are the groups: this is what spreads over a cluster.  A scan is moved once, its
    configurations run one after the other and share what they have in common.
    """
    known = _known(experiments)
    kind = pixels.schema[key].dataType.simpleString()

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        scan, u, v = _scan(pdf, ppm)
        for name, algorithm, kwargs in known:
            labels = kernels.SEG[algorithm](scan, **kwargs)
            yield pd.DataFrame({key: pdf[key], "name": name, "u": pdf["u"], "v": pdf["v"], "label": labels[v, u]})

    return _dealt(pixels, key).groupBy(key).applyInPandas(solve, f"{key} {kind}, name string, u int, v int, label int")


def sweep_confusion(pixels: DataFrame, experiments: list[tuple[str, str, dict]], ppm: float, truth: str, key: str = KEY) -> DataFrame:
    """(key, name, pred, truth, n): the confusion of each of ``sweep``'s runs with the pixels' own column ``truth``.

    Counted where the labels are made, so that none of them moves.
    """
    known = _known(experiments)
    kind = pixels.schema[key].dataType.simpleString()

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(parts, ignore_index=True)
        scan, u, v = _scan(pdf, ppm)
        true = pdf[truth].fillna(-1).to_numpy(np.int64)
        for name, algorithm, kwargs in known:
            pred = kernels.SEG[algorithm](scan, **kwargs)[v, u].astype(np.int64)
            both = (pred >= 0) & (true >= 0)
            pair, n = np.unique(pred[both] << 32 | true[both], return_counts=True)
            yield pd.DataFrame({key: pdf[key].iloc[0], "name": name, "pred": pair >> 32, "truth": pair & 0xFFFFFFFF, "n": n})

    return _dealt(pixels, key).groupBy(key).applyInPandas(solve, f"{key} {kind}, name string, pred int, truth int, n long")


def named(experiments: list[tuple[str, str, dict]], part: str) -> list[tuple[str, str, dict]]:
    """The experiments whose name holds ``part``."""
    return [e for e in experiments if part in e[0]]


def regions(faces: DataFrame, ppm: float, close_m: float = 0.05, least_m2: float = 0.25, key: str = KEY) -> DataFrame:
    """(key, cluster, comp, area_m2, u0, v0, u1, v1): components of each height cluster's closed raster.

    ``faces`` carry corners, their cluster (negative: none) and max_x, max_z of their grid.
    """
    mark = F.concat_ws("|", F.col(key).cast("string"), F.col("cluster").cast("string"))
    rows = faces.filter("cluster >= 0").select(mark.alias("mark"), "cluster", "max_x", "max_z", "p", "q", "r")
    mask = mesh.rasterize(rows, F.col("max_x"), F.col("max_z"), ppm).select("mark", "u", "v").distinct()
    radius = max(3, round(close_m * ppm) | 1) // 2
    whole = raster.close(mask, raster.disc(radius), "mark").withColumn("label", F.substring_index("mark", "|", -1).cast("int"))
    found = raster.component_stats(raster.components(whole, "label", "mark"), "mark").filter(F.col("area") >= int(least_m2 * ppm * ppm))
    name = F.expr("substring(mark, 1, length(mark) - length(cast(label as string)) - 1)").cast(faces.schema[key].dataType)
    return found.select(name.alias(key), F.col("label").alias("cluster"), "comp", (F.col("area") / (ppm * ppm)).alias("area_m2"), "u0", "v0", "u1", "v1")


def segment_ceiling(faces: DataFrame, ppm: float = 100.0, max_tilt: float = 30.0, tolerance: float = 0.05, width: float = 0.005, least_band: float = 0.5, least_m2: float = 0.25, close_m: float = 0.05, key: str = KEY) -> DataFrame:
    """(key, cluster, y, comp, area_m2, u0, v0, u1, v1): the ceiling regions of meshes.

    ``faces``: (key, fid, p, q, r).  Downward faces, their height clusters by area, the
    nearest band of each face, and the components of each cluster's raster.
    """
    down = mesh.downward(mesh.geometry(faces), max_tilt)
    found = heights.clusters(down, "cy", "area", width, tolerance, 0.10, least_band, key)
    bands = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "y", "y_lo", "y_hi"))), lambda b: F.struct(b["y_lo"].alias("lo"), b["y"].alias("mid"), b["y_hi"].alias("hi"))).alias("bands"))
    given = down.join(bands, key).withColumn("cluster", heights.band(F.col("cy"), F.col("bands"))).drop("bands")
    given = given.join(mesh.grid(down, ppm, by=(key,)), key)
    return regions(given, ppm, close_m, least_m2, key).join(found.select(key, "cluster", "y"), [key, "cluster"])


def auto_detect(pixels: DataFrame, y: str, width: int, separation: int, kernel: int, least_area: int, least_cover: float = 0.4, most: int = 5, key: str = KEY) -> DataFrame:
    """(key, u, v, label, region): planes found, cleaned and cut into regions.

    Peaks, nearest plane, nearest fill, median; components under the least area or
    cover are absorbed by the nearest kept one of their plane, where there is none by the
    nearest of any plane.  Region 0 is the largest of its scan, the others follow by area.
    """
    return detected(pixels, y, width, separation, kernel, least_area, least_cover, most, key)[0].drop("plane")


def detected(pixels: DataFrame, y: str, width: float, separation: float, kernel: int, least_area: int, least_cover: float, most: int, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """The pixels (key, u, v, comp, region, plane) of ``auto_detect`` and the peaks (key, peak, y) of their planes.

    ``pixels`` is a whole grid; with a column ``in_room``, only its pixels take part.  Scans
    where no component is kept, or nothing is seen, have no pixels.
    """
    room = F.col("in_room") if "in_room" in pixels.columns else F.lit(True)
    rows = pixels.select(key, "u", "v", F.when(room, F.col(y)).alias("y"), room.alias("in_room"))
    found = save(heights.peaks(rows, "y", width, separation, most=most, key=key), "peaks")
    # pixels meet pixels by merging: files of a few MB hold millions of them, too many to broadcast
    merged = rows.hint("merge")
    filled = raster.nearest_fill(heights.assign(rows, found, "y", key), "label", key).join(merged, [key, "u", "v"])
    # outside the room is a label of its own to the median, after all others
    clean = save(raster.median_filter(filled.withColumn("label", F.when(F.col("in_room"), F.col("label"))), "label", kernel // 2, key), "clean")
    comps = save(raster.components(clean.join(merged.filter("in_room").select(key, "u", "v"), [key, "u", "v"]), "label", key).join(merged, [key, "u", "v"]), "comps")
    size = comps.groupBy(key, "label", "comp").agg(F.count("*").alias("area"), F.count("y").alias("seen"))
    size = size.withColumn("kept", (F.col("area") >= least_area) & (F.col("seen") / F.col("area") >= least_cover))
    told = comps.join(size.select(key, "comp", "kept"), [key, "comp"]).select(key, "u", "v", "label", F.when(F.col("kept"), F.col("comp")).alias("region"))
    marked = save(merged.select(key, "u", "v", "in_room").join(told, [key, "u", "v"], "left"), "marked")

    # once over the whole grid for each plane that has both kept and lost components
    planes = marked.groupBy(key, F.col("label").alias("plane")).agg(F.count("region").alias("n"), F.count("label").alias("of")).filter("n > 0 and n < of").select(key, "plane")
    names = planes.withColumn("layer", F.to_json(F.struct(key, "plane")))
    layers = marked.join(names, key).select("layer", "u", "v", F.when(F.col("label") == F.col("plane"), F.col("region")).alias("label"))
    filled = raster.nearest_fill(layers, "label", "layer")
    filled = filled.join(names, "layer").select(key, "u", "v", F.col("plane").alias("label"), F.col("label").alias("own"))
    marked = marked.hint("merge").join(filled, [key, "u", "v", "label"], "left").withColumn("region", F.coalesce("region", "own")).drop("own", "label")
    whole = raster.nearest_fill(marked, "region", key).filter("label is not null")
    whole = save(whole.join(merged.filter("in_room").select(key, "u", "v"), [key, "u", "v"]), "whole")

    regions = whole.groupBy(key, "label").agg(F.count("*").alias("n")).withColumn("region", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "label")) - 1)
    regions = regions.join(size.select(key, F.col("comp").alias("label"), F.col("label").alias("plane")), [key, "label"])
    return whole.join(regions.select(key, "label", "region", "plane"), [key, "label"]).select(key, "u", "v", F.col("label").alias("comp"), "region", "plane"), found


def snap(masks: DataFrame, room: DataFrame, key: str = KEY) -> DataFrame:
    """(key, u, v, region): overlapping region masks (region 0 is the main) tidied to a tiling of the room.

    Later regions win, the main only where no region is; gaps go to the nearest.
    """
    won = masks.groupBy(key, "u", "v").agg(F.max("region").alias("region"))
    inside = room.select(key, "u", "v").hint("merge").join(won, [key, "u", "v"], "left")
    return raster.nearest_fill(inside, "region", key).withColumnRenamed("label", "region")

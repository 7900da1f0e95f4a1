"""Height histograms, peaks, plane assignment and statistics over pixel tables.

A pixel table has a key (one scan), integer ``u`` and ``v`` and a height that is null
where nothing was seen.  Everything but the peak search aggregates with partial
sums; a peak search works on one short array of bins per scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "session_id"


def _bin(y: Column, width: float) -> Column:
    """The bin of a height; one that rounding puts just under an edge belongs above it."""
    return F.floor((y - F.col("y0")) / width + 1e-9).cast("long")


def histogram(df: DataFrame, y: str, width: int, weight: Column | None = None, key: str = KEY) -> DataFrame:
    """(key, y0, bin, n): bins from one under each scan's least height to one over its highest.

    Empty bins are included, so that a flat lowest or highest plane can be a peak.
    """
    seen = df.filter(F.col(y).isNotNull())
    edge = seen.groupBy(key).agg((F.min(y) - width).alias("y0"), F.max(y).alias("y1"))
    counts = seen.join(edge, key).groupBy(key, _bin(F.col(y), width).alias("bin"))
    counts = counts.agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    last = _bin(F.col("y1"), width) + 1
    bins = edge.select(key, "y0", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    return bins.join(counts, [key, "bin"], "left").select(key, "y0", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def smooth(bins: DataFrame, key: str = KEY) -> DataFrame:
    """Adds ``s``: n under the kernel (1/4, 1/2, 1/4), zero beyond the ends."""
    order = Window.partitionBy(key).orderBy("bin")
    n = F.col("n").cast("double")
    return bins.withColumn("s", 0.25 * F.lag(n, 1, 0.0).over(order) + 0.5 * n + 0.25 * F.lead(n, 1, 0.0).over(order))


def find_peaks(values: Column, distance: int, prominence: Column) -> Column:
    """array<struct<i, s>> of peaks: plateau middles, tallest first within ``distance``, prominent.

    Where none is left, the first highest bin.
    """
    n = F.size(values)
    at = lambda i: F.element_at(values, (i + 1).cast("int"))
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: (i > 0) & (at(F.greatest(i - 1, F.lit(0))) < at(i)))

    def middle(i: Column) -> Column:
        end = F.array_min(F.filter(places, lambda j: (j >= i) & F.when(j == n - 1, F.lit(True)).otherwise(at(F.least(j + 1, n - 1)) != at(i))))
        return F.when((end < n - 1) & (at(F.least(end + 1, n - 1)) < at(i)), F.floor((i + end) / 2).cast("int"))

    tops = F.filter(F.transform(starts, middle), lambda i: i.isNotNull())
    sorted_ = F.array_sort(F.transform(tops, lambda i: F.struct((-at(i)).alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    kept = F.aggregate(sorted_, none, lambda acc, p: F.when(F.exists(acc, lambda k: F.abs(k - p["i"]) < distance), acc).otherwise(F.concat(acc, F.array(p["i"]))))

    def base(i: Column, side: Column) -> Column:
        """The least value between a peak and the next higher bin on one side."""
        seed = F.struct(F.lit(False).alias("stop"), at(i).alias("low"))

        def step(acc, j):
            stop = acc["stop"] | (at(j) > at(i))
            return F.struct(stop.alias("stop"), F.when(stop, acc["low"]).otherwise(F.least(acc["low"], at(j))).alias("low"))

        return F.aggregate(side, seed, step)["low"]

    def prominent(i: Column) -> Column:
        left, right = F.reverse(F.filter(places, lambda j: j < i)), F.filter(places, lambda j: j > i)
        return at(i) - F.greatest(base(i, left), base(i, right)) >= prominence

    found = F.array_sort(F.filter(kept, prominent))
    best = F.array((F.array_position(values, F.array_max(values)) - 1).cast("int"))
    found = F.when(F.size(found) == 0, best).otherwise(found)
    return F.transform(found, lambda i: F.struct(i.alias("i"), at(i).alias("s")))


def peaks(df: DataFrame, y: str, width: int, separation: int, fraction: float = 0.05, most: int = 5, key: str = KEY) -> DataFrame:
    """(key, peak, bin, s, y): the ``most`` tallest peaks of each scan by ascending height."""
    bins = smooth(histogram(df, y, width, key=key), key)
    rows = bins.groupBy(key, "y0").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "s"))), lambda b: b["s"]).alias("values"))
    found = rows.select(key, "y0", find_peaks(F.col("values"), round(separation / width), F.array_max("values") * fraction).alias("found"))
    top = F.slice(F.array_sort(F.transform("found", lambda p: F.struct((-p["s"]).alias("h"), p["i"].alias("i")))), 1, most)
    places = F.array_sort(F.transform(top, lambda p: F.struct(p["i"].alias("i"), (-p["h"]).alias("s"))))
    out = found.select(key, "y0", F.posexplode(places).alias("peak", "p"))
    return out.select(key, "peak", F.col("p.i").cast("long").alias("bin"), F.col("p.s").alias("s"), (F.col("y0") + width * (F.col("p.i") + 0.5)).alias("y"))


def nearest(value: Column, centres: Column) -> Column:
    """Index of the nearest of an array of numbers, the lowest on ties."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(value - c).alias("d"), i.alias("i"))))["i"]


def band(value: Column, bands: Column) -> Column:
    """Index of the band (lo, mid, hi) that holds the value, nearest middle first; -1 for none."""
    inside = F.transform(bands, lambda b, i: F.when(value.between(b["lo"], b["hi"]), F.struct(F.abs(value - b["mid"]).alias("d"), i.alias("i"))))
    return F.coalesce(F.array_min(F.filter(inside, lambda s: s.isNotNull()))["i"], F.lit(-1))


def assign(df: DataFrame, found: DataFrame, y: str, key: str = KEY) -> DataFrame:
    """``df`` plus ``label``: the nearest of its scan's peaks (null where the height is)."""
    centres = found.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("peak", "y"))), lambda p: p["y"]).alias("centres"))
    both = df.join(centres, key, "left")
    return both.withColumn("label", F.when(F.col(y).isNotNull(), nearest(F.col(y), F.col("centres")))).drop("centres")


def stats(df: DataFrame, by: list[str], y: str, digits: int = 6) -> DataFrame:
    """Mean, deviation, extremes, counts and share of valid pixels per group."""
    v = F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.round(F.avg(v), digits).alias("mean_y"),
        F.round(F.stddev_pop(v), digits).alias("std_y"),
        F.min(v).alias("min_y"),
        F.max(v).alias("max_y"),
        F.count(v).alias("n_valid"),
        F.count("*").alias("n_total"),
        F.round(F.count(v) / F.count("*"), digits).alias("valid_frac"),
    )


def band_stats(df: DataFrame, by: list[str], y: str, peak: Column, tolerance: float, digits: int = 6) -> DataFrame:
    """As ``stats``, of the heights within ``tolerance`` of the group's peak, counted against all pixels."""
    near = F.when(F.abs(F.col(y) - peak) <= tolerance, F.col(y))
    return stats(df.withColumn(y, near), by, y, digits)


def relative(regions: DataFrame, datum: DataFrame, key: str = KEY) -> DataFrame:
    """Adds ``relative_y``: a region's mean minus its scan's datum; null if either is."""
    main = datum.select(key, F.col("mean_y").alias("datum"))
    return regions.join(main, key, "left").withColumn("relative_y", F.col("mean_y") - F.col("datum")).drop("datum")


def summary(df: DataFrame, y: str, key: str = KEY) -> DataFrame:
    v = F.col(y).cast("double")
    return df.groupBy(key).agg(F.min(v).alias("min_y"), F.max(v).alias("max_y"), F.median(v).alias("median_y"), F.count(v).alias("valid_px"), F.count("*").alias("total_px"))


def merge_bands(bands: DataFrame, key: str = KEY) -> DataFrame:
    """Merges overlapping bands (y, y_lo, y_hi, area) in ascending order of y.

    Areas add up; the height is that of the larger area, where the one before is
    the accumulated one.
    """
    rows = bands.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("y", "y_lo", "y_hi", "area"))).alias("b"))
    none = F.slice("b", 1, 0)

    def step(acc, b):
        last = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1)))
        merged = F.struct(
            F.when(b["area"] > last["area"], b["y"]).otherwise(last["y"]).alias("y"),
            F.least(last["y_lo"], b["y_lo"]).alias("y_lo"),
            F.greatest(last["y_hi"], b["y_hi"]).alias("y_hi"),
            (last["area"] + b["area"]).alias("area"),
        )
        joins = (F.size(acc) > 0) & (b["y_lo"] <= last["y_hi"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(b)))

    out = rows.select(key, F.posexplode(F.aggregate("b", none, step)).alias("cluster", "m"))
    return out.select(key, "cluster", "m.*")


def clusters(df: DataFrame, y: str, weight: str, width: int, tolerance: int, separation: int, least_area: float, key: str = KEY) -> DataFrame:
    """Height clusters: peaks of the weighted histogram, their bands, merged where they overlap."""
    bins = smooth(histogram(df, y, width, F.col(weight), key), key)
    rows = bins.groupBy(key, "y0").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "s"))), lambda b: b["s"]).alias("values"))
    found = rows.select(key, "y0", F.explode(find_peaks(F.col("values"), round(separation / width), F.array_max("values") * 0.05)).alias("p"))
    mid = F.col("y0") + width * (F.col("p.i") + 0.5)
    edges = found.select(key, mid.alias("y"), (mid - tolerance).alias("y_lo"), (mid + tolerance).alias("y_hi"))
    areas = edges.join(df.select(key, F.col(y).alias("__y"), F.col(weight).alias("__w")), key).filter("__y between y_lo and y_hi")
    bands = areas.groupBy(key, "y", "y_lo", "y_hi").agg(F.sum("__w").alias("area")).filter(F.col("area") >= least_area)
    return merge_bands(bands, key)

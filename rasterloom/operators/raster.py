"""Neighbourhood, component, fill and set operators over long-format pixel tables.

Pixels are rows (key, u, v, ...).  Windows are partitioned by scan and row or column,
so no task holds more than one line of one scan; only the run graph of a scan's
components, and a scan's region graph, are solved in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators.kernels import nearest_columns
from rasterloom.storage import save

KEY = "session_id"


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic kernel."""
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius + radius // 2]


SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def kernel_runs(kernel: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """A kernel's offsets as horizontal runs (dv, first du, last du)."""
    out: list[list[int]] = []
    for dv, du in sorted({(b, a) for a, b in kernel}):
        if out and out[-1][0] == dv and out[-1][2] == du - 1:
            out[-1][2] = du
        else:
            out.append([dv, du, du])
    return [tuple(x) for x in out]


def runs(mask: DataFrame, key: str = KEY) -> DataFrame:
    """(key, v, a, b): the maximal horizontal runs of a mask; repeated pixels count once."""
    line = Window.partitionBy(key, "v").orderBy("u")
    rows = mask.select(key, "u", "v").withColumn("island", F.col("u") - F.dense_rank().over(line))
    return rows.groupBy(key, "v", "island").agg(F.min("u").alias("a"), F.max("u").alias("b")).drop("island")


def run_pixels(lines: DataFrame, key: str = KEY) -> DataFrame:
    return lines.select(key, F.explode(F.sequence(F.col("a").cast("int"), F.col("b").cast("int"))).alias("u"), F.col("v").cast("int"))


def _stepped(lines: DataFrame, kernel: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*(F.struct(F.lit(dv).alias("dv"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dv, lo, hi in kernel_runs(kernel)))
    return lines.withColumn("s", F.explode(steps))


def dilate_runs(lines: DataFrame, kernel: list[tuple[int, int]], key: str = KEY) -> DataFrame:
    """Runs of the dilation: each run widened by each run of the kernel, overlaps merged line by line."""
    wide = _stepped(lines, kernel).select(key, (F.col("v") + F.col("s.dv")).alias("v"), (F.col("a") + F.col("s.lo")).alias("a"), (F.col("b") + F.col("s.hi")).alias("b"))
    line = Window.partitionBy(key, "v").orderBy("a", "b")
    reach = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    wide = wide.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return wide.groupBy(key, "v", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def erode_runs(lines: DataFrame, kernel: list[tuple[int, int]], key: str = KEY) -> DataFrame:
    """Runs of the erosion: where the shrunk runs of all runs of the kernel meet, by a sweep along each line."""
    shrunk = _stepped(lines, kernel).select(key, (F.col("v") - F.col("s.dv")).alias("v"), (F.col("a") - F.col("s.lo")).alias("a"), (F.col("b") - F.col("s.hi")).alias("b")).filter("a <= b")
    turns = shrunk.select(key, "v", F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("d")))).alias("t"))
    turns = turns.groupBy(key, "v", F.col("t.at").alias("a")).agg(F.sum("t.d").alias("d"))
    line = Window.partitionBy(key, "v").orderBy("a")
    held = turns.withColumn("n", F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("b", F.lead("a").over(line) - 1)
    return held.filter(F.col("n") == len(kernel_runs(kernel))).select(key, "v", "a", "b")


def dilate(mask: DataFrame, kernel: list[tuple[int, int]], key: str = KEY) -> DataFrame:
    """Pixels within the kernel of a mask pixel; the plane has no border.

    Morphology works on horizontal runs: what is multiplied is runs by the kernel's runs,
    never pixels by its area.
    """
    return run_pixels(dilate_runs(runs(mask, key), kernel, key), key)


def erode(mask: DataFrame, kernel: list[tuple[int, int]], key: str = KEY) -> DataFrame:
    """Pixels whose whole kernel lies in the mask."""
    return run_pixels(erode_runs(runs(mask, key), kernel, key), key)


def close(mask: DataFrame, kernel: list[tuple[int, int]], key: str = KEY, times: int = 1) -> DataFrame:
    """``times`` dilations, then as many erosions."""
    lines = runs(mask, key)
    for step in (dilate_runs, erode_runs):
        for _ in range(times):
            lines = step(lines, kernel, key)
    return run_pixels(lines, key)


def median_filter(df: DataFrame, label: str, radius: int, key: str = KEY) -> DataFrame:
    """(key, u, v, label): the middle label of a (2r+1)-square, borders replicated.

    The grid is dense; labels are any integers, ordered as such, a null label after all
    others.  Labels are ranked within their scan; counts by rank are packed into as many
    64-bit words as they need, each wide enough for the whole square, and two running sums
    serve all words.
    """
    names = df.groupBy(key).agg(
        F.array_sort(F.collect_set(F.col(label))).alias("names"),
        F.max(F.col(label).isNull().cast("int")).alias("holes"),
        *(f(c).alias(n + c) for c in "uv" for f, n in ((F.min, "low_"), (F.max, "high_"))),
    )
    names = save(names, "median-names")
    most = names.agg(F.max(F.size("names") + F.col("holes"))).first()[0] or 1
    bits = ((2 * radius + 1) ** 2).bit_length()
    each = 63 // bits
    words = [f"word{w}" for w in range(-(-most // each))]
    rank = F.when(F.col(label).isNull(), F.size("names")).otherwise(F.array_position("names", F.col(label)).cast("int") - 1)
    rows = df.join(names, key).withColumn("rank", rank).drop("names", "holes")
    rows = rows.withColumns({w: F.when(F.floor(F.col("rank") / each) == k, F.expr(f"shiftleft(1L, cast({bits} * (rank % {each}) as int))")).otherwise(F.lit(0).cast("long")) for k, w in enumerate(words)})

    def spread(c: str) -> Column:
        first = F.when(F.col(c) == F.col(f"low_{c}"), F.col(c) - radius).otherwise(F.col(c))
        last = F.when(F.col(c) == F.col(f"high_{c}"), F.col(c) + radius).otherwise(F.col(c))
        return F.explode(F.sequence(first, last))

    wide = rows.withColumn("pu", spread("u")).withColumn("pv", spread("v")).select(key, "u", "v", "pu", "pv", *words)
    across = Window.partitionBy(key, "pv").orderBy("pu").rowsBetween(-radius, radius)
    down = Window.partitionBy(key, "pu").orderBy("pv").rowsBetween(-radius, radius)
    sums = wide.withColumns({w: F.sum(w).over(across) for w in words})
    sums = sums.filter("pu = u").withColumns({w: F.sum(w).over(down) for w in words}).filter("pv = v")
    counts = F.array(*(F.shiftright(words[k // each], bits * (k % each)).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for k in range(most)))
    half = (2 * radius + 1) ** 2 // 2
    # the middle rank is the number of ranks up to which no more than half of the square lies
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("rank"))
    step = lambda acc, n: F.struct((acc["upto"] + n).alias("upto"), (acc["rank"] + F.when(acc["upto"] + n <= half, 1).otherwise(0)).alias("rank"))
    sums = sums.withColumn("rank", F.aggregate(counts, start, step)["rank"]).select(key, "u", "v", "rank")
    return sums.join(names.select(key, "names"), key).select(key, "u", "v", F.get("names", "rank").alias("label"))


def gradient(df: DataFrame, y: str, key: str = KEY) -> DataFrame:
    """Adds ``gx`` and ``gy``: Sobel differences, mirrored at the borders of a dense grid."""

    def both(value: Column, w: Window) -> tuple[Column, Column]:
        low, high = F.lag(value).over(w), F.lead(value).over(w)
        return F.coalesce(low, high), F.coalesce(high, low)

    across, down = Window.partitionBy(key, "v").orderBy("u"), Window.partitionBy(key, "u").orderBy("v")
    low, high = both(F.col(y), across)
    rows = df.withColumn("__d", high - low).withColumn("__s", low + 2 * F.col(y) + high)
    (a, b), (c, d) = both(F.col("__d"), down), both(F.col("__s"), down)
    return rows.withColumn("gx", a + 2 * F.col("__d") + b).withColumn("gy", d - c).drop("__d", "__s")


def _union_find(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest connected id of each of the sorted ``ids``."""
    at = np.arange(len(ids))
    a, b = np.searchsorted(ids, left), np.searchsorted(ids, right)
    while True:
        low = np.minimum(at[a], at[b])
        new = at.copy()
        np.minimum.at(new, at[a], low)
        np.minimum.at(new, at[b], low)
        new = new[new]
        if (new == at).all():
            return ids[at]
        at = new


def components(df: DataFrame, label: str = "label", key: str = KEY) -> DataFrame:
    """(key, u, v, label, comp) of 8-connected pixels of one label; null labels drop out.

    ``comp`` is v * 2^20 + u of the component's first pixel by (v, u).
    """
    rows = df.filter(F.col(label).isNotNull()).select(key, "u", "v", F.col(label).alias("label"))
    line = Window.partitionBy(key, "v", "label").orderBy("u")
    rows = rows.withColumn("island", F.col("u") - F.row_number().over(line))
    runs = rows.groupBy(key, "v", "label", "island").agg(F.min("u").alias("a"), F.max("u").alias("b"))
    runs = runs.withColumn("run", F.col("v").cast("long") * (1 << 20) + F.col("a"))
    upper = runs.select(key, (F.col("v") + 1).alias("v"), "label", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("run").alias("other"))
    pairs = runs.join(upper, [key, "v", "label"]).filter("a <= b2 + 1 and a2 <= b + 1").select(key, "run", "other")
    graph = pairs.unionByName(runs.select(key, "run", F.col("run").alias("other")))
    kind = df.schema[key].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["run"].to_numpy())
        comp = _union_find(ids, pdf["run"].to_numpy(), pdf["other"].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "run": ids, "comp": comp})

    found = graph.groupBy(key).applyInPandas(solve, f"{key} {kind}, run long, comp long")
    named = runs.join(found, [key, "run"]).select(key, "v", "label", "island", "comp")
    return rows.join(named, [key, "v", "label", "island"]).select(key, "u", "v", "label", "comp")


def component_stats(comps: DataFrame, key: str = KEY) -> DataFrame:
    return comps.groupBy(key, "label", "comp").agg(
        F.count("*").alias("area"), F.min("u").alias("u0"), F.min("v").alias("v0"), (F.max("u") + 1).alias("u1"), (F.max("v") + 1).alias("v1")
    )


def adjacency(df: DataFrame, label: str = "label", key: str = KEY) -> DataFrame:
    """(key, a, b): distinct 4-adjacent label pairs, a < b."""
    parts = []
    for line, along in (("v", "u"), ("u", "v")):
        w = Window.partitionBy(key, line).orderBy(along)
        next_ = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(label).over(w))
        parts.append(df.filter(F.col(label).isNotNull()).withColumn("__n", next_).filter(F.col("__n") != F.col(label)).select(key, F.least(label, "__n").alias("a"), F.greatest(label, "__n").alias("b")))
    return parts[0].unionByName(parts[1]).distinct()


def merge_by_height(df: DataFrame, y: str, threshold: float, label: str = "label", key: str = KEY) -> DataFrame:
    """(key, label, merged): adjacent labels whose mean heights differ by less, transitively.

    Labels without a height never merge; the smallest label stands for its group.
    """
    means = df.filter(F.col(label).isNotNull()).groupBy(key, F.col(label).alias("label")).agg(F.avg(F.col(y).cast("double")).alias("mean"))
    a, b = (means.select(key, F.col("label").alias(n), F.col("mean").alias(f"mean_{n}")) for n in "ab")
    close_ = adjacency(df, label, key).join(a, [key, "a"]).join(b, [key, "b"]).filter(F.abs(F.col("mean_a") - F.col("mean_b")) < threshold).select(key, "a", "b")
    graph = close_.unionByName(means.select(key, F.col("label").alias("a"), F.col("label").alias("b")))
    kinds = (df.schema[key].dataType.simpleString(), df.schema[label].dataType.simpleString())

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(pdf["a"].to_numpy())
        ids = np.unique(np.concatenate([ids, pdf["b"].to_numpy()]))
        return pd.DataFrame({key: pdf[key].iloc[0], "label": ids, "merged": _union_find(ids, pdf["a"].to_numpy(), pdf["b"].to_numpy())})

    return graph.groupBy(key).applyInPandas(solve, f"{key} {kinds[0]}, label {kinds[1]}, merged {kinds[1]}")


def compact(df: DataFrame, label: str = "label", key: str = KEY) -> DataFrame:
    """Adds ``compact``: labels renumbered from 0 by ascending old label (null stays)."""
    names = df.filter(F.col(label).isNotNull()).select(key, F.col(label).alias("__l")).distinct()
    names = names.withColumn("compact", F.dense_rank().over(Window.partitionBy(key).orderBy("__l")) - 1)
    return df.join(names.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & (F.col(label) == F.col("__l")), "left").drop("__k", "__l")


def nearest_fill(df: DataFrame, label: str = "label", key: str = KEY) -> DataFrame:
    """(key, u, v, label): each pixel without a label takes that of the nearest with one.

    Exact Euclidean distance, ties to the smaller (v, u).  Two passes: nearest
    labelled pixel in the column by windows, then for each line the lower envelope of the
    columns' parabolas, in time linear in the line.
    """
    down = Window.partitionBy(key, "u").orderBy("v")
    said = F.when(F.col(label).isNotNull(), F.struct(F.col("v").alias("at"), F.col(label).alias("label")))
    rows = df.withColumn("said", said)
    rows = rows.withColumn("up", F.last("said", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("low", F.first("said", ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing)))
    lines = rows.select(key, "u", "v", F.col("up.at").alias("v1"), F.col("up.label").alias("l1"), F.col("low.at").alias("v2"), F.col("low.label").alias("l2"))
    kinds = [df.schema[c].dataType.simpleString() for c in (key, "u", "v", label)]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = int(pdf["v"].iloc[0])
        pdf = pdf.sort_values("u")
        u = pdf["u"].to_numpy(dtype=np.int64)
        v1, v2, l1, l2 = (pdf[c].to_numpy(dtype=float) for c in ("v1", "v2", "l1", "l2"))
        # of each column the nearer labelled pixel, the upper one on ties
        upper = ~np.isnan(v1) & ~(v2 - v < v - v1)
        at, said = np.where(upper, v1, v2), np.where(upper, l1, l2)
        some = ~np.isnan(at)
        if not some.any():
            return pd.DataFrame({key: pdf[key], "u": u, "v": v, "label": pd.array([None] * len(u), "Int64")})
        best = nearest_columns(u[some], at[some].astype(np.int64), u, v)
        return pd.DataFrame({key: pdf[key], "u": u, "v": v, "label": said[some][best].astype(np.int64)})

    return lines.groupBy(key, "v").applyInPandas(solve, f"{key} {kinds[0]}, u {kinds[1]}, v {kinds[2]}, label {kinds[3]}")


def _between(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.struct(low.cast("int").alias("a"), high.cast("int").alias("b")))


def _down(a: Column, b: Column) -> Column:
    """Whole division that rounds down; ``b`` is above 0."""
    return F.floor(a.cast("long") / b.cast("long"))


def _edge_run(e: Column) -> Column:
    """The pixels (a, b) of an edge in line ``v``: of its points k = 0 to n, those that round to the line."""
    a, du, dv = e["a"], e["b"]["u"] - e["a"]["u"], e["b"]["v"] - e["a"]["v"]
    n, at = F.greatest(F.abs(du), F.abs(dv), F.lit(1)), (F.col("v") - a["v"]).cast("long")
    up = F.greatest(F.abs(dv), F.lit(1))
    # along u: the ks whose height rounds to ``at``
    first = F.when(dv > 0, -_down(n - 2 * n * at, 2 * up)).when(dv < 0, _down(n - 2 * n * (at + 1), 2 * up) + 1)
    last = F.when(dv > 0, -_down(n - 2 * n * (at + 1), 2 * up) - 1).when(dv < 0, _down(n - 2 * n * at, 2 * up))
    first, last = (F.when(dv != 0, x).when(at == 0, y) for x, y in ((F.greatest(first, F.lit(0)), F.lit(0)), (F.least(last, n.cast("long")), F.abs(du))))
    along = F.when(first <= last, F.when(du > 0, _between(a["u"] + first, a["u"] + last)).otherwise(_between(a["u"] - last, a["u"] - first)))
    # steeper: one pixel a line
    one = a["u"] + _down(2 * at * F.signum(dv).cast("int") * du + n, 2 * n)
    within = (F.col("v") >= F.least(a["v"], e["b"]["v"])) & (F.col("v") <= F.greatest(a["v"], e["b"]["v"]))
    return F.when(within, F.when(F.abs(du) > F.abs(dv), along).otherwise(_between(one, one)))


def fill_polygons(polygons: DataFrame, poly: str = "poly") -> DataFrame:
    """(others, u, v): the other columns and the pixels of each polygon of ``array<struct<u, v>>`` in whole pixels.

    Even-odd interior by scanlines, and the pixels of the edges.  Polygons equal in all
    other columns form a union.  Polygons are dealt over the tasks before they are drawn;
    each scanline merges its own runs, so that no pixel is ever sorted or hashed.
    """
    spark, others = polygons.sparkSession, [c for c in polygons.columns if c != poly]
    dealt = polygons.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *others)
    alike = dealt.groupBy(*others).agg(F.collect_set(poly).alias("__all"))
    corners = F.flatten(F.transform("__all", lambda p: F.transform(p, lambda a: a["v"])))
    rows = alike.withColumn("v", F.explode(F.sequence(F.array_min(corners), F.array_max(corners))))

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cut = (a["v"] <= F.col("v")) != (b["v"] <= F.col("v"))
        return F.when(cut, a["u"] + (F.col("v") - a["v"]) * (b["u"] - a["u"]) / (b["v"] - a["v"]))

    def drawn(p: Column) -> Column:
        edges = F.transform(p, lambda a, i: F.struct(a.alias("a"), F.element_at(p, (i + 1) % F.size(p) + 1).alias("b")))
        xs = F.array_sort(F.filter(F.transform(edges, crossing), lambda x: x.isNotNull()))
        inner = F.transform(xs, lambda x, i: F.when(i % 2 == 0, _between(F.ceil(x), F.floor(F.get(xs, i + 1)))))
        return F.concat(inner, F.transform(edges, _edge_run))

    runs_ = F.array_sort(F.filter(F.flatten(F.transform("__all", drawn)), lambda s: s.isNotNull()))
    # what is left of each run after those that begin before it
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("out"), F.lit(None).cast("int").alias("end"))

    def step(acc: Column, s: Column) -> Column:
        first = F.greatest(s["a"], acc["end"] + 1)
        some = F.when(first <= s["b"], F.array(F.struct(first.alias("a"), s["b"].alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.struct(F.concat(acc["out"], some).alias("out"), F.greatest(acc["end"], s["b"]).alias("end"))

    spans = rows.select(*others, "v", F.explode(F.aggregate(runs_, start, step)["out"]).alias("__s"))
    return spans.select(*others, F.explode(F.sequence("__s.a", "__s.b")).alias("u"), "v")


def last_wins(pixels: DataFrame, order: str, keys: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """(keys, order): the highest order at each pixel."""
    return pixels.groupBy(*keys).agg(F.max(order).alias(order))


#: Side of the squares that boxes meet in, in pixels; boxes alike that meet in one group.
SQUARE_PX, MEET = 16, 2048


def region_pairs(regions: DataFrame, least: int = 8, key: str = KEY) -> DataFrame:
    """(key, a, b, u0, v0, u1, v1): regions of different clusters whose boxes share ``least`` pixels each way.

    ``regions``: (key, id, cluster, y, u0, v0, u1, v1), ends exclusive; the lower region is ``a``.

    Regions of one box and cluster are one class.  Classes meet in the square that holds the
    lower corner of what they share, so each pair of classes is found once; only those that
    fit are then opened up, ``MEET`` by ``MEET`` regions in a group at most.  What is left to
    grow with the square of the input is the result.
    """
    box = ["cluster", "u0", "v0", "u1", "v1"]
    pad = max(0, (2 - least) // 2)  # boxes that needn't touch are widened until they must
    rows = regions.filter(" and ".join(f"{c} is not null" for c in [key, "y", *box])).hint("merge")
    classes = rows.groupBy(key, *box).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / MEET).cast("int"))
    squares = classes
    for c in "uv":
        first, last = F.col(f"{c}0") - pad, F.col(f"{c}1") + pad - 1
        low, high = F.floor(first / SQUARE_PX), F.floor(last / SQUARE_PX)
        squares = squares.filter(first <= last).withColumn(f"s{c}", F.explode(F.sequence(low, high)))
    a, b = (squares.select(key, "su", "sv", *(F.col(c).alias(f"{n}_{c}") for c in [*box, "parts"])) for n in "ab")
    low, high = ({c: f(f"a_{c}{e}", f"b_{c}{e}") for c in "uv"} for f, e in ((F.greatest, 0), (F.least, 1)))
    met = a.join(b, [key, "su", "sv"]).filter("a_cluster <> b_cluster")
    for c in "uv":
        met = met.filter((high[c] - low[c] >= least) & (F.floor((low[c] - pad) / SQUARE_PX) == F.col(f"s{c}")))
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(f"{n}_parts") - 1)).alias(f"{n}_part")
    shared = [low["u"].alias("u0"), low["v"].alias("v0"), high["u"].alias("u1"), high["v"].alias("v1")]
    met = met.select(key, *(f"{n}_{c}" for n in "ab" for c in box), *shared, part("a"), "b_parts").withColumn("b_part", part("b")).drop("b_parts")
    dealt = rows.join(classes.select(key, *box, "parts"), [key, *box]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    for n in "ab":
        side = dealt.select(key, *(F.col(c).alias(f"{n}_{c}") for c in [*box, "part", "id", "y"]))
        met = met.join(side.hint("merge"), [key, *(f"{n}_{c}" for c in [*box, "part"])])
    return met.filter("a_y < b_y or (a_y = b_y and a_id < b_id)").select(key, F.col("a_id").alias("a"), F.col("b_id").alias("b"), "u0", "v0", "u1", "v1")


def fractions(pairs: DataFrame) -> DataFrame:
    """Shares of a common box covered by only a, only b, and either (``pairs`` as for patterns)."""
    share = lambda c: F.round(F.avg(F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))), 6)
    only = {"only_a": F.col("in_a") & ~F.col("in_b"), "only_b": F.col("in_b") & ~F.col("in_a"), "either": F.col("in_a") | F.col("in_b")}
    return pairs.groupBy("a", "b").agg(*(share(c).alias(n) for n, c in only.items()))

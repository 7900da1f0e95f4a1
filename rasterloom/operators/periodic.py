"""Periodic composites: pairs of regions that alternate, as battens or tiles do.

Shares, counts and height differences are aggregates over the pixels of a pair's common
box, and pairs that fail them go before anything else is done.  The correlogram of the
rest, how each pair's field goes with itself at every move up to the longest pitch, is
a table; the pitch is its highest row, the strength across a join with the moves at right
angles, the alternation a window over the pixels along the pitch.  Only the transform of
one pair's box is a grouped function.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.operators import kernels
from rasterloom.storage import save

KEY = "session_id"
#: Least sides of a box and pixels of a field, share of the pitch's strength that makes a grid.
BOX, FIELD, ACROSS = 8, 64, 0.6
#: Digits of a correlation that count; moves as strong as that go to the least (dv, du).
DIGITS = 9
#: Rows of pixels or moves that a task sorts, about; tables of any size go to as many tasks as that takes.
ROWS = 1 << 18


def gated(pairs: DataFrame, most_delta: float, least_each: float, least_both: float, key: str = KEY) -> DataFrame:
    """(key, a, b, u0, v0, width, height, only_a, only_b, either, delta_y): pairs that can be composites."""
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    in_a, in_b = (F.coalesce(f"in_{x}", F.lit(False)) for x in "ab")
    box = pairs.groupBy(key, "a", "b").agg(
        F.min("u").alias("u0"), F.min("v").alias("v0"), (F.max("u") - F.min("u") + 1).alias("width"), (F.max("v") - F.min("v") + 1).alias("height"),
        one(in_a & ~in_b).alias("only_a"), one(in_b & ~in_a).alias("only_b"), one(in_a | in_b).alias("either"),
        F.count_if(in_a != in_b).alias("__n"), F.max("delta_y").alias("delta_y"),
    )
    fits = (F.col("width") >= BOX) & (F.col("height") >= BOX) & (F.col("__n") >= FIELD) & ~(F.abs("delta_y") > most_delta)
    return box.filter(fits & (F.col("only_a") >= least_each) & (F.col("only_b") >= least_each) & (F.col("either") >= least_both)).drop("__n")


def _tasks(boxes: DataFrame, reach: int) -> int:
    """Over how many tasks to deal the fields and moves of these boxes."""
    size = F.col("width").cast("long") * F.col("height")
    rows = boxes.agg(F.sum(F.greatest(size, F.lit((2 * reach + 1) ** 2).cast("long")))).first()[0] or 0
    return max(boxes.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def correlogram(field: DataFrame, reach: int, key: str = KEY) -> DataFrame:
    """(key, a, b, du, dv, c): each pair's field (key, a, b, u, v, value) against itself, moved by at most ``reach``."""
    kind = ", ".join(f"{c} {field.schema[c].dataType.simpleString()}" for c in (key, "a", "b"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf["u"].to_numpy() - pdf["u"].min(), pdf["v"].to_numpy() - pdf["v"].min()
        box = np.zeros((v.max() + 1, u.max() + 1))
        box[v, u] = pdf["value"]
        found = kernels.autocorrelation(box)
        dv, du = (np.arange(-n, n) for n in box.shape)
        near = np.hypot(dv[:, None], du[None]) <= reach
        row, col = np.nonzero(near)
        names = {c: pdf[c].iloc[0] for c in (key, "a", "b")}
        return pd.DataFrame(names | {"du": du[col], "dv": dv[row], "c": found[near]}, index=range(len(row)))

    return field.groupBy(key, "a", "b").applyInPandas(solve, f"{kind}, du int, dv int, c double")


def composites(
    pairs: DataFrame, ppm: float, least_peak: float = 0.35, pitch: tuple[float, float] = (0.08, 0.6), least_turns: int = 4, most_delta: float = 0.4, least_each: float = 0.10, least_both: float = 0.45, key: str = KEY
) -> DataFrame:
    """(key, a, b, kind, pitch_m, angle, strength, across, delta_y, only_a, only_b, turns) of pairs that alternate.

    ``pairs``: (key, a, b, u, v, in_a, in_b, delta_y) for every pixel of the common box, ``a`` the
    lower region; a null delta_y passes.  ``angle`` is in degrees from u towards v.
    """
    near, far = max(3, int(pitch[0] * ppm)), int(pitch[1] * ppm)
    pair = [key, "a", "b"]
    boxes = save(gated(pairs, most_delta, least_each, least_both, key), "boxes")
    value = F.coalesce("in_b", F.lit(False)).cast("int") - F.coalesce("in_a", F.lit(False)).cast("int")
    field = save(pairs.join(boxes.select(pair), pair, "left_semi").select(*pair, "u", "v", value.alias("value")), "field")
    tasks = _tasks(boxes, far + 1)
    dealt = field.repartition(tasks, *pair)  # coalesced to a task a core, they would grow with the table
    moves = save(correlogram(dealt, far + 1, key).withColumn("c", F.round("c", DIGITS)), "correlogram")
    length = F.sqrt((F.col("du") * F.col("du") + F.col("dv") * F.col("dv")).cast("double"))
    # numbers alone are aggregated, which takes no sorting: first the height, then the least place of that height
    ring = moves.filter(length.between(near, far) & F.lit(far > near))
    tops = save(ring.groupBy(pair).agg(F.max("c").alias("c")).filter(F.col("c") >= least_peak), "tops")
    place = F.col("dv").cast("long") * (1 << 32) + F.col("du")
    peaks = ring.join(tops, [*pair, "c"]).groupBy(*pair, "c").agg(F.min(place).alias("place"))
    dv = F.shiftright(F.col("place") + (1 << 31), 32)
    peaks = peaks.select(*pair, dv.cast("int").alias("pv"), (F.col("place") - dv * (1 << 32)).cast("int").alias("pu"), F.col("c").alias("strength"))
    peaks = save(peaks.withColumn("length", F.sqrt((F.col("pu") * F.col("pu") + F.col("pv") * F.col("pv")).cast("double"))), "peaks")
    # pixels and moves stay where they are: a pair's peak comes to them, and a product tells most that lie
    # off its line, as rounding moves none by more than half a diagonal
    along = lambda u, v: u * F.col("pu") + v * F.col("pv")
    aside = lambda u, v: v * F.col("pu") - u * F.col("pv")

    # at right angles: (pu, pv) turned by a quarter, at every length of the ring
    du, dv = F.col("du"), F.col("dv")
    turned = lambda r: (F.rint(-r * F.col("pv") / F.col("length")) == du) & (F.rint(r * F.col("pu") / F.col("length")) == dv)
    across = moves.join(peaks, pair).filter(F.abs(along(du, dv)) <= F.col("length")).filter(F.exists(F.sequence(F.lit(near), F.lit(max(near, far))), turned))
    across = across.groupBy(pair).agg(F.max("c").alias("across"))

    # the pixels on the line through the middle of the box, in order, none where the field is 0; one can be there twice
    reach = F.floor(F.sqrt((F.col("width") * F.col("width") + F.col("height") * F.col("height")).cast("double")))
    u, v = (F.col(c) - F.col(f"{c}0") - F.floor(F.col(size) / 2) for c, size in (("u", "width"), ("v", "height")))
    line = lambda t: (F.rint(t * F.col("pu") / F.col("length")) == u) & (F.rint(t * F.col("pv") / F.col("length")) == v) & (F.abs(t) <= reach)
    first = F.floor(along(u, v) / F.col("length")) - 1
    met = field.filter("value <> 0").join(peaks, pair).join(boxes, pair).filter(F.abs(aside(u, v)) <= F.col("length"))
    met = met.select(*pair, F.explode(F.filter(F.sequence(first, first + 3), line)).alias("t"), "value")
    turn = F.lag("value").over(Window.partitionBy(pair).orderBy("t")) != F.col("value")
    turns = met.withColumn("turn", turn).groupBy(pair).agg(F.count_if("turn").alias("turns")).filter(F.col("turns") >= least_turns)

    found = peaks.join(turns, pair).join(boxes, pair).join(across, pair, "left").withColumn("across", F.greatest(F.coalesce("across", F.lit(0.0)), F.lit(0.0)))
    kind = F.when(F.col("across") >= ACROSS * F.col("strength"), F.lit("grid")).otherwise(F.lit("linear"))
    angle = F.degrees(F.atan2(F.col("pv").cast("double"), F.col("pu").cast("double")))
    return found.select(*pair, kind.alias("kind"), (F.col("length") / ppm).alias("pitch_m"), angle.alias("angle"), "strength", "across", "delta_y", "only_a", "only_b", "turns")

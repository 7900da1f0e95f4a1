"""Texts, colours and small conversions of the plan document, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Warn beyond this deviation (m) and under this coverage; longest note.
ROUGH, SPARSE, NOTE = 0.05, 0.6, 500


def hex_channel(colour: Column, channel: int) -> Column:
    """Channel 0, 1 or 2 of ``#rgb`` or ``#rrggbb``."""
    digits = F.ltrim(colour, F.lit("#"))
    digits = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    return F.conv(F.substring(digits, 2 * channel + 1, 2), 16, 10).cast("int")


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def height_tag(relative: Column) -> Column:
    """Signed millimetres of a height in metres; a dash where it is unknown."""
    size = F.bround(F.abs(relative) * 1000).cast("long").cast("string")
    sign = F.when(relative >= 0, F.lit("+")).otherwise(F.lit("−"))
    return F.when(relative.isNull(), F.lit("—")).otherwise(F.concat(sign, size, F.lit(" mm")))


def tint(region: Column, palette: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, palette)), (F.pmod(region, F.lit(len(palette))) + 1).cast("int"))


def shade(y: Column, mean: Column, range_m: float, base: int, valid: Column, alpha: float = 0.55) -> tuple[Column, Column]:
    """(channel, alpha) of a pixel by its deviation from the mean height."""
    dev = F.least(F.greatest((y - mean) / max(range_m, 1e-6), F.lit(-1.0)), F.lit(1.0))
    light = F.least(F.greatest(0.7 + 0.3 * dev, F.lit(0.35)), F.lit(1.0))
    boost = F.greatest(dev, F.lit(0.0))
    value = base * light + (255 - base * light) * boost / 2
    return value.cast("int"), F.when(valid, F.lit(round(255 * alpha))).otherwise(F.lit(0))


def warnings(std: Column, valid_frac: Column) -> Column:
    said = F.array(F.when(std > ROUGH, F.lit("uneven")), F.when(valid_frac < SPARSE, F.lit("sparse")))
    return F.filter(said, lambda s: s.isNotNull())


def note(x: Column) -> Column:
    return F.substring(x.cast("string"), 1, NOTE)


def typed(value: Column) -> Column:
    """struct<i, f, s>: an integer, else a number, else the text itself."""
    i, f = value.try_cast("bigint"), value.try_cast("double")
    i = F.when(value.rlike(r"^[+-]?\d+$"), i)
    return F.struct(i.alias("i"), F.when(i.isNull(), f).alias("f"), F.when(i.isNull() & f.isNull(), value).alias("s"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.bround(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def new_session() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)

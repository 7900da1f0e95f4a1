"""Plan documents as rows: edits of rooms, main ceilings and regions, and their sinks.

A plan has one row per polygon: (session_id, kind, id, label, notes, polygon, mean_y),
kind being room, main or region.  Edits are unions, filters and joins on that table, so a
batch of edits over many plans is one query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import labels

KEY = "session_id"
COLUMNS = [KEY, "kind", "id", "label", "notes", "polygon", "mean_y"]


def checked(polygon: Column) -> Column:
    return F.when(F.size(polygon) >= 3, polygon).otherwise(F.raise_error(F.lit("a polygon needs three vertices")))


def add_regions(plan: DataFrame, new: DataFrame) -> DataFrame:
    """Appends (session_id, label, polygon, mean_y) as regions with the next free ids."""
    last = plan.filter("kind = 'region'").groupBy(KEY).agg(F.max("id").alias("last"))
    n = F.row_number().over(Window.partitionBy(KEY).orderBy("label", "mean_y"))
    rows = new.join(last, KEY, "left").withColumn("id", F.coalesce("last", F.lit(-1)) + n)
    label = F.coalesce("label", F.concat(F.lit("Ceiling Region ("), (F.col("id") + 2).cast("string"), F.lit(")")))
    rows = rows.select(KEY, F.lit("region").alias("kind"), "id", label.alias("label"), F.lit("").alias("notes"), checked(F.col("polygon")).alias("polygon"), "mean_y")
    return plan.select(COLUMNS).unionByName(rows)


def set_single(plan: DataFrame, kind: str, new: DataFrame) -> DataFrame:
    """Sets or replaces the room or main polygon of plans; the old notes go."""
    rows = new.select(KEY, F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("id"), "label", F.lit("").alias("notes"), checked(F.col("polygon")).alias("polygon"), "mean_y")
    others = plan.select(COLUMNS).join(new.select(KEY, F.lit(kind).alias("kind")).distinct(), [KEY, "kind"], "left_anti")
    return others.select(COLUMNS).unionByName(rows)


def update_regions(plan: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies (session_id, id, label, notes, polygon): null leaves a field as it is."""
    c = changes.select(KEY, "id", *(F.col(x).alias(f"new_{x}") for x in ("label", "notes", "polygon"))).withColumn("kind", F.lit("region"))
    both = plan.join(c, [KEY, "kind", "id"], "left").withColumn("new_notes", labels.note(F.col("new_notes")))
    return both.withColumns({x: F.coalesce(f"new_{x}", x) for x in ("label", "notes", "polygon")}).select(COLUMNS)


def set_main_notes(plan: DataFrame, notes: DataFrame) -> DataFrame:
    """Replaces the notes of mains by those of (session_id, notes); a plan without a main is an error."""
    new = notes.select(KEY, labels.note(F.col("notes")).alias("new_notes"))
    mains = plan.filter("kind = 'main'").select(KEY, F.lit(True).alias("has_main")).distinct()
    told = new.join(mains, KEY, "left")
    told = told.withColumn("new_notes", F.when(F.col("has_main"), F.coalesce("new_notes", F.lit(""))).otherwise(F.raise_error(F.lit("the plan has no main ceiling"))))
    both = plan.join(told.select(KEY, "new_notes"), KEY, "left")
    return both.withColumn("notes", F.when((F.col("kind") == "main") & F.col("new_notes").isNotNull(), F.col("new_notes")).otherwise(F.col("notes"))).select(COLUMNS)


def hit_test(clicks: DataFrame, shapes: DataFrame, reach: float, by: str = KEY, favour: float = 0.8) -> DataFrame:
    """(by, name, vertex) of each click (by, x, z, selected) that hits a shape (by, name, position, polygon).

    The nearest vertex within ``reach``, the selected shape's distances counted
    ``favour`` times; else the smallest shape around the click, with no vertex.
    """
    mine = F.col("name").eqNullSafe(F.col("selected"))
    both = clicks.join(shapes, by).withColumn("turn", F.when(mine, F.lit(-1)).otherwise(F.col("position")))
    x, z, bias = F.col("x"), F.col("z"), F.when(mine, F.lit(favour)).otherwise(F.lit(1.0))
    away = F.transform("polygon", lambda p, i: F.struct((F.sqrt((p["x"] - x) * (p["x"] - x) + (p["z"] - z) * (p["z"] - z)) * bias).alias("d"), F.col("turn").alias("turn"), i.alias("vertex"), F.col("name").alias("name")))
    near = F.array_min(F.filter(away, lambda s: s["d"] < reach))
    around = F.when(geo.contains("polygon", x, z), F.struct(geo.area("polygon").alias("area"), F.col("turn").alias("turn"), F.col("name").alias("name")))
    best = both.groupBy(by).agg(F.min(near).alias("near"), F.min(around).alias("around"))
    hit = best.select(by, F.coalesce("near.name", "around.name").alias("name"), F.col("near.vertex").alias("vertex"))
    return hit.filter("name is not null")


def delete_regions(plan: DataFrame, gone: DataFrame) -> DataFrame:
    """Removes (session_id, id); ids that aren't there are no error."""
    return plan.join(gone.select(KEY, "id", F.lit("region").alias("kind")), [KEY, "id", "kind"], "left_anti").select(COLUMNS)


def with_relative(plan: DataFrame) -> DataFrame:
    """Adds ``relative_y`` and its tag: heights over the plan's main, null if either is missing."""
    datum = plan.filter("kind = 'main'").select(KEY, F.col("mean_y").alias("datum"))
    rel = F.when(F.col("kind") == "region", F.col("mean_y") - F.col("datum"))
    return plan.join(datum, KEY, "left").withColumn("relative_y", rel).withColumn("tag", F.when(F.col("kind") == "main", F.lit("0 mm")).otherwise(labels.height_tag(rel))).drop("datum")


def to_json(plan: DataFrame) -> DataFrame:
    """(session_id, plan): one JSON document per plan."""
    fields = F.struct("id", "label", "notes", "polygon", "relative_y", "mean_y")
    rows = with_relative(plan)
    doc = rows.groupBy(KEY).agg(
        F.max(F.when(F.col("kind") == "room", F.col("polygon"))).alias("room"),
        F.max(F.when(F.col("kind") == "main", fields)).alias("main"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "region", fields))).alias("regions"),
    )
    return doc.select(KEY, F.to_json(F.struct(KEY, "room", "main", "regions")).alias("plan"))


def latest(versions: DataFrame) -> DataFrame:
    """(session_id, plan): the newest version of each stored plan."""
    return versions.groupBy(KEY).agg(F.max_by("plan", "version").alias("plan"))


def truth_snapshot(plan: DataFrame) -> DataFrame:
    """Geometry only, of plans that have a room and a main."""
    whole = plan.filter("kind in ('room', 'main')").groupBy(KEY).agg(F.count_distinct("kind").alias("n")).filter("n = 2").select(KEY)
    return with_relative(plan).join(whole, KEY).select(KEY, "kind", "id", "label", "notes", "polygon", "relative_y")

"""Detection and snapping to plan rows on closed-form scans."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.operators import compose

PPM = 20.0


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(k, 10.0, 8.0) for k in range(5)], "session_id long, max_x double, max_z double")


def scan(spark, key, y, room="true", w=80, h=60):
    rows = spark.range(w * h).selectExpr(f"{key}L session_id", f"cast(id % {w} as int) u", f"cast(id div {w} as int) v")
    return rows.withColumn("y", F.expr(f"cast({y} as double)")).withColumn("in_room", F.expr(room))


def area(row):
    p = [(q.x, q.z) for q in row.polygon]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2


def test_detect_orders_regions_and_reports_problems(spark, grid):
    # a main at 2.6 m, a higher and a lower region, a speck of the higher plane inside the main, a few holes
    y = "case when u = 7 and v = 50 then null when u < 25 and v < 30 then 2.9 when u >= 50 and v >= 30 then 2.3 when u between 40 and 42 and v between 10 and 12 then 2.9 else 2.6 end"
    rows = scan(spark, 0, y).unionByName(scan(spark, 1, "2.5", "false")).unionByName(scan(spark, 2, "null")).unionByName(scan(spark, 3, "case when u % 8 = 0 then 2.4 end"))
    got = compose.detect(rows, grid, PPM).orderBy("session_id", "kind", "id").collect()
    assert [(r.session_id, r.kind, r.problem) for r in got[3:]] == [(1, "problem", compose.NO_ROOM), (2, "problem", compose.UNSEEN), (3, "problem", compose.UNSEEN)]
    main, low, high = got[:3]
    assert (main.kind, main.id, main.label, main.tint, main.relative_y) == ("main", None, "Main Ceiling (1)", "#80cbc4", None)
    assert [(r.id, r.label, r.tint) for r in (low, high)] == [(0, "Ceiling Region (2)", "#ff7043"), (1, "Ceiling Region (3)", "#9c27b0")]
    assert abs(low.relative_y + 0.3) < 1e-6 and abs(high.relative_y - 0.3) < 1e-6
    assert abs(area(low) - 29 * 29 / PPM**2) < 0.05 and abs(area(high) - 24 * 29 / PPM**2) < 0.05
    assert main.n_total + low.n_total + high.n_total == 80 * 60
    # what the median leaves of the speck lies in a region that isn't of its height
    assert main.std_y < 1e-6 and main.n_valid < main.n_total


def test_lost_components_go_to_their_own_plane_first(spark):
    from rasterloom.operators import segment

    # a small island of the left plane next to the right plane's large field
    y = "case when u < 20 then 2400 when u between 60 and 65 and v between 20 and 25 then 2400 else 2600 end"
    rows = scan(spark, 0, y).withColumn("y", F.col("y").cast("int"))
    got = segment.auto_detect(rows, "y", 5, 100, 3, 100).filter("u = 62 and v = 22").first()
    left = segment.auto_detect(rows, "y", 5, 100, 3, 100).filter("u = 3 and v = 3").first()
    assert got.region == left.region == 1


def test_snap_tiles_the_room_and_keeps_names(spark, grid):
    def box(u0, v0, u1, v1):
        return geo.polygon([(10.0 - u / PPM - 0.001, 8.0 - v / PPM - 0.001) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))])

    def plan(key, kind, id_, label, polygon):
        return spark.range(1).select(F.lit(key).cast("long").alias("session_id"), F.lit(kind).alias("kind"), F.lit(id_).cast("long").alias("id"), F.lit(label).alias("label"), F.lit("n").alias("notes"), polygon.alias("polygon"))

    rows = scan(spark, 0, "case when u < 44 then 2.5 else 2.75 end").unionByName(scan(spark, 1, "2.5")).unionByName(scan(spark, 2, "2.5"))
    drawn = plan(0, "main", None, "m", box(0, 0, 40, 59)).unionByName(plan(0, "region", 7, "r", box(48, 0, 79, 59)))
    # scan 1: the region covers the whole main; scan 2: no main
    drawn = drawn.unionByName(plan(1, "main", None, "m", box(10, 10, 20, 20))).unionByName(plan(1, "region", 0, "r", box(0, 0, 79, 59))).unionByName(plan(2, "region", 0, "r", box(0, 0, 79, 59)))
    got = compose.snap(drawn, rows, grid, PPM).orderBy("session_id", "kind").collect()
    assert [(r.session_id, r.problem) for r in got[2:]] == [(1, compose.MAIN_LOST), (2, compose.NO_MAIN)]
    main, region = got[:2]
    assert (main.label, main.notes, main.id, region.label, region.id, region.notes) == ("m", "n", None, "r", 7, "n")
    # the gap from 41 to 47 is split in the middle, ties to the smaller side
    assert {(round((10.0 - p.x) * PPM), round((8.0 - p.z) * PPM)) for p in main.polygon} == {(0, 0), (44, 0), (44, 59), (0, 59)}
    assert {(round((10.0 - p.x) * PPM), round((8.0 - p.z) * PPM)) for p in region.polygon} == {(45, 0), (79, 0), (79, 59), (45, 59)}
    assert region.std_y < 1e-6 and abs(region.mean_y - 2.75) < 1e-6 and 0.24 < region.relative_y < 0.25


def test_rooms_of_any_shape(spark, grid):
    # an L-shaped room: what lies outside it neither counts nor is claimed, heights there neither
    room = "u < 30 or v >= 40"
    y = "case when not (u < 30 or v >= 40) then 9 when v >= 40 then 2.8 when u = 12 and v between 10 and 12 then null else 2.5 end"
    rows = scan(spark, 0, y, room)
    got = compose.detect(rows, grid, PPM, least_edge=0.1, least_seen=500).orderBy("kind", "id").collect()
    # outside counts as a plane above all others, so the median gives the inner corner's pixel to the main
    assert [(r.kind, r.n_total) for r in got] == [("main", 80 * 20 + 1), ("region", 30 * 40 - 1)]
    assert abs(got[0].mean_y - 2.8) < 1e-6 and abs(got[1].mean_y - 2.5) < 1e-6 and got[1].n_valid == 30 * 40 - 4
    corners = lambda r: {(round((10.0 - p.x) * PPM), round((8.0 - p.z) * PPM)) for p in r.polygon}
    # a ring's first pixel always stays
    assert corners(got[0]) == {(29, 39), (0, 40), (79, 40), (79, 59), (0, 59)}
    assert {(0, 0), (29, 0), (0, 39)} < corners(got[1]) and abs(area(got[1]) - 29 * 39 / PPM**2) < 0.1

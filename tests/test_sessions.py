"""Stored sessions, wall rasters, ceiling regions and plan edits on hand-made cases."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.operators import documents, mesh, segment
from rasterloom.plans import catalog
from rasterloom.sources import sessions

GRID = {"min_x": 0.0, "max_x": 4.0, "min_z": 0.0, "max_z": 3.0, "pixels_per_metre": 1.0, "width": 4, "height": 3}


def picture(width, height, colour):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = (b"\0" + bytes(colour) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def root(tmp_path):
    for name, room in (("one", [[4, 3], [2, 3], [2, 1], [4, 1]]), ("two", None)):
        out = tmp_path / name / "out"
        out.mkdir(parents=True)
        square = [[4, 3], [3, 3], [3, 2], [4, 2]]
        region = {"id": 7, "polygon": square, "label": "r", "notes": "", "stats": {"mean_y": 2.5}}
        main = {"polygon": [[4, 3], [1, 3], [1, 1], [4, 1]], "label": "m", "notes": "n", "stats": {"mean_y": 2.25}}
        (out / "plan.json").write_text(json.dumps({"session_id": name, "grid": GRID, "room": room, "main": main, "regions": [region]}, indent=2))
        heights = np.full((3, 4), 2.5, np.float32)
        heights[0, 0], heights[2, 3] = np.nan, np.inf
        np.save(out / "height.npy", heights)
        np.save(out / "wall_edges.npy", np.eye(3, 4, dtype=np.uint8))
        (out / "ceiling.jpg").write_bytes(picture(4, 3, (10, 20, 30)))
    return str(tmp_path)


def test_plan_and_truth(spark, root):
    docs = sessions.documents(spark, f"{root}/*/out/plan.json")
    rows = {(r.session_id, r.kind): r for r in sessions.polygons(docs).collect()}
    assert len(rows) == 5 and ("two", "room") not in rows
    assert rows["one", "region"].id == 7 and rows["one", "region"].position == 1 and rows["one", "main"].mean_y == 2.25
    got = {(r.u, r.v): r.label for r in sessions.truth_labels(docs).filter("session_id = 'one'").collect()}
    assert {p for p, k in got.items() if k == 1} == {(0, 0), (1, 0), (0, 1), (1, 1)}
    assert {p for p, k in got.items() if k == 0} == {(2, 0), (3, 0), (2, 1), (3, 1), (0, 2), (1, 2), (2, 2), (3, 2)}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sessions.documents(spark, f"{root}/three/out/plan.json").count()


def test_scans_from_sessions(spark, root):
    rows = {(r.session_id, r.u, r.v): r for r in sessions.load_scans(spark, root).collect()}
    assert len(rows) == 24
    assert rows["one", 0, 0].y is None and rows["one", 3, 2].y is None and rows["one", 1, 1].y == 2.5
    assert {(u, v) for s, u, v in rows if s == "one" and rows[s, u, v].in_room} == {(u, v) for u in range(3) for v in range(3)}
    assert sum(rows[k].in_room for k in rows if k[0] == "two") == 10
    assert {(u, v) for s, u, v in rows if s == "two" and rows[s, u, v].is_wall} == {(0, 0), (1, 1), (2, 2)}
    assert {(r.r, r.g, r.b) for r in rows.values()} == {(10, 20, 30)}


def slab(fid, x, z, size, y):
    """Two triangles that look down."""
    at = lambda a, b: (float(x + a), float(y), float(z + b))
    return [(1, fid, at(0, 0), at(size, 0), at(0, size)), (1, fid + 1, at(size, 0), at(size, size), at(0, size))]


def test_ceiling_regions(spark):
    point = "struct<x: double, y: double, z: double>"
    rows = spark.createDataFrame(slab(0, 0, 0, 2, 2.4) + slab(2, 2, 0, 2, 2.7) + slab(4, 8, 0, 2, 2.4), f"session_id long, fid long, p {point}, q {point}, r {point}")
    assert mesh.downward(mesh.geometry(rows)).count() == 6
    got = sorted((r.cluster, round(r.y, 2), r.area_m2) for r in segment.segment_ceiling(rows, 10.0).collect())
    assert [g[:2] for g in got] == [(0, 2.4), (0, 2.4), (1, 2.7)]
    # edge pixels belong to a fill: 21 or, where a corner is truncated downwards, 22 pixels a side
    assert all(round(g[2], 2) in (4.41, 4.62, 4.84) for g in got), got


def test_wall_raster(spark):
    point = "struct<x: double, y: double, z: double>"
    upright = [(1, 0, (1.0, 2.4, 1.0), (3.0, 2.4, 1.0), (3.0, 2.6, 1.0)), (1, 1, (1.0, 0.0, 2.0), (3.0, 0.0, 2.0), (3.0, 2.4, 2.0))]
    rows = mesh.geometry(spark.createDataFrame(upright, f"session_id long, fid long, p {point}, q {point}, r {point}"))
    rows = rows.selectExpr("*", "4D max_x", "3D max_z", "4 width", "3 height")
    got = {(r.u, r.v) for r in mesh.wall_raster(rows, F.lit(2.4), 1.0, "session_id").collect()}
    assert got == {(u, v) for u in range(4) for v in (1, 2)}  # the tall wall is left out, the edge of the grid cuts


def test_main_notes_need_a_main(spark):
    plan = spark.createDataFrame([(1, "main", None, "m", "old", 2.0), (2, "region", 0, "r", "kept", 2.3)], "session_id long, kind string, id long, label string, notes string, mean_y double")
    plan = plan.withColumn("polygon", geo.polygon([(0, 0), (1, 0), (1, 1)])).select(documents.COLUMNS)
    notes = lambda *r: spark.createDataFrame(r, "session_id long, notes string")
    assert {r.session_id: r.notes for r in documents.set_main_notes(plan, notes((1, "x" * 600))).collect()} == {1: "x" * 500, 2: "kept"}
    with pytest.raises(Exception, match="no main ceiling"):
        documents.set_main_notes(plan, notes((2, "new"))).collect()


def test_experiments_by_name():
    assert [e[0] for e in segment.named(catalog.EXPERIMENTS, "wall_constrained")] == ["wall_constrained_010", "wall_constrained_030", "wall_constrained_060"]
    assert segment.named(catalog.EXPERIMENTS, "none such") == []

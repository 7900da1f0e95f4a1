"""Small hand-made cases for the table operators, sources and documents."""

import json

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import labels as text
from rasterloom.operators import documents, heights, raster, scoring
from rasterloom.sources import scans

OBJ = "mtllib a b.mtl\n# note\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvn 0 0 1\nvt 0 0\nf 1 2 3\nusemtl one\nf 1/1 2/1 3/1 4/1\nusemtl two\nf 1//3 2 3\nusemtl one\nf 1 2 3 4 1\n"


@pytest.fixture
def lines(spark, tmp_path):
    (tmp_path / "mesh.obj").write_text(OBJ)
    return scans.read_lines(spark, str(tmp_path / "mesh.obj"))


def test_obj_scan(lines):
    assert scans.vertices(lines).count() == 4 and scans.uvs(lines).count() == 1
    assert scans.mtllib(lines).first().mtl == "a b.mtl"
    tri = scans.faces(lines).orderBy("fid").collect()
    assert [r.mat for r in tri] == [-1, 0, 0, 1, 0, 0, 0]
    assert tri[1].v == [0, 1, 2] and tri[2].v == [0, 2, 3] and tri[1].t == [0, 0, 0] and tri[3].t == [0, 1, 2]


def test_mtl_and_report(spark, tmp_path):
    (tmp_path / "a.mtl").write_text("newmtl one\nmap_Kd old.jpg\nmap_Kd my tex.jpg\nnewmtl two\nmap_Kd gone.jpg\n")
    (tmp_path / "mesh.obj").write_text(OBJ)
    (tmp_path / "my tex.jpg").write_text("x")
    (tmp_path / "depth").mkdir()
    (tmp_path / "depth" / "x.png").write_text("x")
    tex = scans.textures(scans.read_lines(spark, str(tmp_path / "a.mtl")))
    assert {r.name: r.texture for r in tex.collect()} == {"one": "my tex.jpg", "two": "gone.jpg"}
    files = scans.folder(spark, str(tmp_path)).withColumn("name", F.replace("name", F.lit("%20"), F.lit(" ")))
    assert files.filter("path like '%depth%'").isEmpty()
    lib = spark.createDataFrame([("a.mtl",)], "mtl string")
    row = scans.report(files, lib, tex).first()
    assert row.ok and row.textures_missing == ["gone.jpg"] and len(row.warnings) == 2


def test_alignment(spark, tmp_path):
    (tmp_path / "mesh_info.json").write_text(json.dumps({"alignmentTransform": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 5, 6, 7, 1]}))
    assert scans.alignment(spark, str(tmp_path / "mesh_info.json")) == [1, 0, 0, -5, 0, 1, 0, -6, 0, 0, 1, -7]


def test_area_and_edits(spark):
    square = geo.polygon([(0, 0), (2, 0), (2, 2), (0, 2)])
    row = spark.range(1).select(
        geo.area(square).alias("a"), F.size(geo.delete_vertex(square, F.lit(0))).alias("d"), geo.contains(square, F.lit(1.0), F.lit(1.0)).alias("i"), geo.contains(square, F.lit(3.0), F.lit(1.0)).alias("o")
    ).first()
    assert (row.a, row.d, row.i, row.o) == (4.0, 3, True, False)
    for bad in (geo.delete_vertex(geo.polygon([(0, 0), (1, 0), (0, 1)]), F.lit(0)), geo.move_vertex(square, F.lit(9), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("z")))):
        with pytest.raises(Exception, match="vertex|vertices"):
            spark.range(1).select(bad).collect()


def test_round_trip_and_short_edges(spark):
    u, v = geo.world_to_px(F.lit(1.5), F.lit(2.5), 4, 5, 100)
    x, z = geo.px_to_world(u, v, 4, 5, 100)
    kept = geo.long_edges(geo.polygon([(0, 0), (0.1, 0), (2, 0), (2, 2), (0, 2), (0, 0.1)]), 0.5)
    row = spark.range(1).select(x.alias("x"), z.alias("z"), F.size(kept).alias("n")).first()
    assert (row.x, row.z, row.n) == (1.5, 2.5, 4)


def test_labels(spark):
    row = spark.range(1).select(text.hex_channel(F.lit("#fa0"), 0).alias("r"), text.height_tag(F.lit(-0.0125)).alias("t"), text.finite(F.lit(float("nan"))).alias("f"), text.warnings(F.lit(0.1), F.lit(0.5)).alias("w")).first()
    assert (row.r, row.t, row.f, row.w) == (255, "−12 mm", None, ["uneven", "sparse"])


def test_merged_bands_keep_the_larger_height(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.95, 1.05, 2.0), (1, 1.08, 1.03, 1.13, 3.0), (1, 1.15, 1.10, 1.20, 4.0), (1, 2.0, 1.95, 2.05, 1.0)], "session_id long, y double, y_lo double, y_hi double, area double")
    got = [(r.y, r.area) for r in heights.merge_bands(rows).orderBy("cluster").collect()]
    assert got == [(1.08, 9.0), (2.0, 1.0)]


def test_empty_tables(spark):
    px = spark.createDataFrame([], "session_id long, u int, v int, y double, label int")
    assert heights.peaks(px, "y", 5, 100).count() == 0
    assert raster.components(px).count() == 0
    assert raster.nearest_fill(px).count() == 0
    assert raster.median_filter(px, "label", 2).count() == 0
    assert scoring.score(px.selectExpr("session_id", "label pred", "label truth")).count() == 0


def test_scan_without_labels_stays_unlabelled(spark):
    px = spark.createDataFrame([(1, 0, 0, None), (1, 1, 0, None)], "session_id long, u int, v int, label int")
    assert raster.nearest_fill(px).filter("label is not null").isEmpty()


def test_score_of_permuted_labels_is_one(spark):
    rows = spark.createDataFrame([(1, (k % 3), (k % 3 + 1) % 3) for k in range(30)], "session_id long, pred int, truth int")
    row = scoring.score(rows).first()
    assert (row.mean_iou, row.min_iou, row.weighted_iou) == (1.0, 1.0, 1.0)


def test_missed_truth_counts_zero(spark):
    rows = spark.createDataFrame([(1, 0, 0)] * 6 + [(1, 0, 1)] * 2, "session_id long, pred int, truth int")
    row = scoring.score(rows).first()
    assert (row.min_iou, row.mean_iou, row.weighted_iou) == (0.0, 0.375, 0.75)


def test_documents(spark):
    poly = geo.polygon([(0, 0), (1, 0), (1, 1)])
    base = spark.createDataFrame([(1, "main", None, "m", "", 2.0), (1, "region", 0, "r", "", 2.3)], "session_id long, kind string, id long, label string, notes string, mean_y double")
    plan = base.withColumn("polygon", poly).select(documents.COLUMNS)
    new = spark.createDataFrame([(1, None, 2.1)], "session_id long, label string, mean_y double").withColumn("polygon", poly)
    grown = documents.add_regions(plan, new)
    assert {(r.id, r.label) for r in grown.filter("kind = 'region'").collect()} == {(0, "r"), (1, "Ceiling Region (3)")}
    tags = {r.id: r.tag for r in documents.with_relative(grown).collect()}
    assert tags == {None: "0 mm", 0: "+300 mm", 1: "+100 mm"}
    gone = documents.delete_regions(grown, spark.createDataFrame([(1, 0), (1, 99)], "session_id long, id long"))
    assert gone.count() == 2 and len(json.loads(documents.to_json(gone).first().plan)["regions"]) == 1
    assert documents.truth_snapshot(gone).count() == 0

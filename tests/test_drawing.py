"""Drawing tables of a plan: texts, places, dimensions and the page."""

from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.operators import drawing


def plan(spark):
    square, small = geo.polygon([(0, 0), (4, 0), (4, 2), (0, 2)]), geo.polygon([(1, 1), (2, 1), (2, 2)])
    rows = [(1, "room", None, None, None, None), (1, "main", None, None, "by hand", 2.5), (1, "region", 0, None, "", 2.25), (1, "region", 11, "niche", None, None), (2, "main", None, "no room", "", 2.0)]
    df = spark.createDataFrame(rows, "session_id long, kind string, id long, label string, notes string, mean_y double")
    return df.withColumn("polygon", F.when(F.col("kind") == "region", small).otherwise(square))


def test_marks(spark):
    got = {(r.layer, r.item): r for r in drawing.marks(plan(spark)).collect()}
    assert set(got) == {("shape", None), ("shape", 0), ("shape", 11), ("room", None), *(("dimension", k) for k in range(4))}
    assert got["shape", None].text == "Main Ceiling (1)\n0 mm\nby hand" and (got["shape", None].x, got["shape", None].z) == (2.0, 1.0)
    assert (got["shape", 0].text, got["shape", 0].face, got["shape", 0].edge) == ("region 0\n−250 mm", "#ff7043", "#444")
    assert got["shape", 11].text == "niche\n—" and got["shape", 11].face == "#9c27b0"
    assert got["dimension", 0].text == "4000 mm" and abs(got["dimension", 0].z + 0.18) < 1e-12
    assert got["dimension", 1].text == "2000 mm" and abs(got["dimension", 1].angle) == 90 and abs(got["dimension", 1].x - 4.18) < 1e-12


def test_pages(spark):
    (page,) = drawing.pages(plan(spark)).collect()
    assert (page.session_id, page.title) == (1, "Reflected Ceiling Plan — session 1")
    assert (page.min_x, page.max_x, page.min_z, page.max_z, page.page_width) == (-0.5, 4.5, -0.5, 2.5, 11.0)
    assert page.page_height == 8.5
    assert drawing.pages(plan(spark).limit(0)).isEmpty() and drawing.marks(plan(spark).limit(0)).isEmpty()

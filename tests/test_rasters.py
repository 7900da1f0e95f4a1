"""Renders, overlays, medians, morphology and nearest fills against closed forms and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernels, raster, render


def table(spark, image, session=1):
    h, w = image.shape
    rows = [(session, u, v, None if image[v, u] is None else int(image[v, u])) for v in range(h) for u in range(w)]
    return spark.createDataFrame(rows, "session_id long, u int, v int, label int")


def image(df, column, shape, session=1):
    out = np.full(shape, None, object)
    for r in df.filter(F.col("session_id") == session).collect():
        out[r.v, r.u] = r[column]
    return out


# --- textured render


def face(fid, mat, y, corners, uvs):
    point = lambda x, z: (float(x), float(y), float(z))
    return (7, fid, mat, *(point(*c) for c in corners), *((float(a), float(b)) for a, b in uvs))


FACE = "key int, fid int, mat int, " + ", ".join(f"{n} struct<x:double,y:double,z:double>" for n in "pqr") + ", " + ", ".join(f"t{n} struct<u:double,v:double>" for n in "pqr")


def textured(spark, rows, materials=((7, 0, 4, 4),)):
    faces = spark.createDataFrame(rows, FACE).withColumns({"max_x": F.lit(8.0), "max_z": F.lit(8.0), "width": F.lit(9), "height": F.lit(9)})
    texels = spark.createDataFrame([(7, 0, i, j, 10 * i, 40 * j, 7) for i in range(4) for j in range(4)], "key int, mat int, tu int, tv int, r int, g int, b int")
    known = spark.createDataFrame(list(materials), "key int, mat int, tw int, th int")
    return {(r.u, r.v): (r.r, r.g, r.b, r.fid, r.y) for r in render.textured(faces, known, texels, 1.0).collect()}


def test_two_triangles_show_the_texture(spark):
    # pixel (u, v) = (8 - x, 8 - z); texel (sx, sy) = (u / 2, v / 2) inside the square, so colours follow from the place
    square = [(8, 8), (0, 8), (0, 0), (8, 0)]
    uv = [(0, 1), (1, 1), (1, 0), (0, 0)]
    got = textured(spark, [face(0, 0, 2, [square[k] for k in (0, 1, 2)], [uv[k] for k in (0, 1, 2)]), face(1, 0, 2, [square[k] for k in (0, 2, 3)], [uv[k] for k in (0, 2, 3)])])
    assert set(got) == {(u, v) for u in range(9) for v in range(9)}

    def bilinear(s, step):
        # beyond the last texel the border counts twice
        low = [0, 1, 2, 3, 3][int(s)]
        high = [0, 1, 2, 3, 3][min(int(s) + 1, 4)]
        return step * (low * (1 - s % 1) + high * (s % 1))

    for (u, v), (r, g, b, _, _) in got.items():
        assert (r, g, b) == (int(bilinear(u / 2, 10) + 0.5), int(bilinear(v / 2, 40) + 0.5), 7)


def test_lower_face_wins_and_odd_faces_drop(spark):
    tri, uv = [(8, 8), (4, 8), (8, 4)], [(0, 1), (0.5, 1), (0, 0.5)]
    rows = [face(3, 0, 2.5, tri, uv), face(2, 0, 2.0, tri, uv), face(1, 0, 2.0, tri, uv)]
    assert {x[3] for x in textured(spark, rows).values()} == {1}
    flat = face(0, 0, 1.0, [(8, 8), (4, 8), (0, 8)], uv)
    outside = face(0, 0, 1.0, [(-5, -5), (-9, -5), (-5, -9)], uv)
    assert {x[3] for x in textured(spark, [*rows, flat, outside, face(0, -1, 1.0, tri, uv), face(0, 5, 1.0, tri, uv)]).values()} == {1}
    black = textured(spark, [face(0, 1, 1.0, tri, uv)], [(7, 1, None, None)])
    assert len(black) == 15 and {x[:3] for x in black.values()} == {(0, 0, 0)}


def test_texture_corners(spark):
    faces = spark.createDataFrame([(1, 0, [0, 1, 2]), (1, 1, [0, 1, 9])], "key int, fid int, t array<bigint>")
    uvs = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(3)], "key int, tid long, u double, v double")
    got = render.uv_corners(faces, uvs).collect()
    assert [(r.fid, r.tr.u) for r in got] == [(0, 2.0)]


@pytest.mark.parametrize("at", range(-9, 10))
def test_reflection_repeats_the_border(spark, at):
    expected = np.pad(np.arange(4), 12, mode="symmetric")[at + 12]
    assert spark.range(1).select(render.reflected(F.lit(at), F.lit(4)).alias("x")).first().x == expected


# --- medians


def plain_median(grid, radius):
    h, w = grid.shape
    out = np.empty((h, w), object)
    for v in range(h):
        for u in range(w):
            near = [grid[min(max(v + a, 0), h - 1), min(max(u + b, 0), w - 1)] for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
            out[v, u] = sorted(near, key=lambda x: (x is None, x))[len(near) // 2]
    return out


@pytest.mark.parametrize("radius, labels", [(0, 3), (2, 2), (7, 40), (20, 12)])
def test_median_of_any_labels(spark, radius, labels):
    rng = np.random.default_rng(radius)
    one, two = (rng.integers(0, labels, (18, 25)).astype(object) * 37 - 100 for _ in range(2))
    two[rng.random(two.shape) < 0.3] = None
    got = raster.median_filter(table(spark, one).unionByName(table(spark, two, 2)), "label", radius)
    assert (image(got, "label", one.shape) == plain_median(one, radius)).all()
    assert (image(got, "label", two.shape, 2) == plain_median(two, radius)).all()


def test_median_of_one_large_label(spark):
    got = raster.median_filter(table(spark, np.full((5, 5), 7, object)), "label", 1)
    assert {r.label for r in got.collect()} == {7}


# --- morphology


def moved(mask, kernel):
    return {(u + a, v + b) for u, v in mask for a, b in kernel}


@pytest.mark.parametrize("kernel", [raster.CROSS, raster.SQUARE, raster.disc(4), [(0, 0), (3, 0), (4, 0), (-2, 5)], [(2, 1)]], ids=str)
def test_morphology_on_runs(spark, kernel):
    rng = np.random.default_rng(4)
    mask = {(int(u), int(v)) for v, u in np.argwhere(rng.random((22, 30)) < 0.75)}
    df = spark.createDataFrame([(1, u, v) for u, v in mask for _ in range(2)], "session_id long, u int, v int")
    at = lambda df: {(r.u, r.v) for r in df.collect()}
    erased = lambda m: {(u - a, v - b) for u, v in m for a, b in kernel if all((u - a + c, v - b + d) in m for c, d in kernel)}
    assert at(raster.dilate(df, kernel)) == moved(mask, kernel)
    assert at(raster.erode(df, kernel)) == erased(mask)
    assert at(raster.close(df, kernel, times=2)) == erased(erased(moved(moved(mask, kernel), kernel)))


def test_dilation_moves_runs_not_pixels(spark):
    wide = spark.range(2000).selectExpr("1L session_id", "cast(id as int) u", "0 v")
    stepped = raster._stepped(raster.runs(wide), raster.disc(10))
    assert stepped.count() == len(raster.kernel_runs(raster.disc(10))) == 21


# --- nearest fills


def plain_nearest(labels):
    at = np.argwhere(labels >= 0)
    out = np.empty(labels.shape, int)
    for v in range(labels.shape[0]):
        for u in range(labels.shape[1]):
            d = ((at - [v, u]) ** 2).sum(axis=1)
            out[v, u] = labels[tuple(at[np.lexsort((at[:, 1], at[:, 0], d))[0]])]
    return out


@pytest.mark.parametrize("share", [0.005, 0.05, 0.5])
def test_nearest_fill(spark, share):
    rng = np.random.default_rng(int(share * 1000))
    labels = np.where(rng.random((40, 33)) < share, np.arange(40 * 33).reshape(40, 33), -1)
    labels[17, 5] = 3
    expected = plain_nearest(labels)
    assert (kernels.nearest_labels(labels, np.ones(labels.shape, bool)) == expected).all()
    got = raster.nearest_fill(table(spark, np.where(labels >= 0, labels, None)))
    assert (image(got, "label", labels.shape).astype(int) == expected).all()


def test_a_wide_hole_splits_in_the_middle():
    labels = np.full((3, 1001), -1)
    labels[:, 0], labels[:, 1000] = 4, 9
    filled = kernels.nearest_labels(labels, np.ones(labels.shape, bool))
    assert (filled[:, :501] == 4).all() and (filled[:, 501:] == 9).all()


# --- overlays


def test_layers_blend_in_order(spark):
    base = spark.createDataFrame([(1, 0, 0, 100, 100, 100), (1, 1, 0, 9, 9, 9)], "session_id long, u int, v int, r int, g int, b int")
    layers = spark.createDataFrame([(1, 0, 0, k, r, 0, 0, a) for k, r, a in ((2, 0, 0.25), (0, 200, 0.5), (1, 50, 1.0))], "session_id long, u int, v int, layer int, r int, g int, b int, alpha double")
    got = {r.u: (r.r, r.g, r.b) for r in render.overlay(base, layers).collect()}
    assert got == {0: (38, 0, 0), 1: (9, 9, 9)}
    assert {r.r for r in render.overlay(base, layers.limit(0)).collect()} == {100, 9}


def test_coverage(spark):
    labels = spark.createDataFrame([(1, 0, 0, 0), (1, 2, 0, 0), (1, 3, 1, 5), (1, 4, 0, -1), (1, 9, 9, 0)], "session_id long, u int, v int, label int")
    room = spark.createDataFrame([(1, u, v) for u in range(5) for v in range(2)], "session_id long, u int, v int")
    got = {r.label: (r.n, r.mean_u, r.mean_v, r.percent) for r in render.coverage(labels, room).collect()}
    assert got == {0: (2, 1.0, 0.0, 20.0), 5: (1, 3.0, 1.0, 10.0), -1: (3, 5 / 3, 1 / 3, 30.0)}

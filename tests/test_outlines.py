"""Outlines by pointer doubling against closed-form rings and facts of the masks."""

import numpy as np
import pytest

from rasterloom.operators import kernels, outline


def table(spark, masks):
    rows = [(k, int(u), int(v)) for k, m in masks.items() for v, u in np.argwhere(m)]
    return spark.createDataFrame(rows, "session_id long, u int, v int")


def points(row):
    return [(p.u, p.v) for p in row.points]


def test_nested_holes_and_islands(spark):
    mask = np.zeros((20, 20), bool)
    mask[1:15, 2:16] = True
    mask[4:12, 5:13] = False
    mask[6:9, 7:10] = True
    got = outline.rings(table(spark, {7: mask}), ["session_id"]).orderBy("ring").collect()
    assert [(r.hole, r.pixels, r.sides) for r in got] == [(False, 196, 56), (True, 64, 32), (False, 9, 12)]
    assert points(got[0]) == [(2, 1), (15, 1), (15, 14), (2, 14)]
    # the ring of a hole lies on the pixels around it and cuts the corners
    assert set(points(got[1])) == {(5, 3), (12, 3), (13, 4), (13, 11), (12, 12), (5, 12), (4, 11), (4, 4)}
    assert points(got[2]) == [(7, 6), (9, 6), (9, 8), (7, 8)] and got[2].area == 4.0


def test_diagonals_touch_and_gaps_do_not(spark):
    cross = np.eye(4, dtype=bool)
    ring = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], bool)
    got = outline.rings(table(spark, {1: cross, 2: ring}), ["session_id"]).collect()
    assert sorted((r.session_id, r.hole, r.sides) for r in got) == [(1, False, 16), (2, False, 12), (2, True, 4)]


def test_single_pixels_lines_and_repeats(spark):
    dot, line = np.zeros((3, 3), bool), np.zeros((3, 9), bool)
    dot[1, 1], line[1, 2:8] = True, True
    rows = table(spark, {1: dot, 2: line})
    got = {r.session_id: r for r in outline.rings(rows.unionByName(rows), ["session_id"]).collect()}
    assert points(got[1]) == [(1, 1)] and points(got[2]) == [(2, 1), (7, 1)] and got[2].area == 0
    assert outline.largest(outline.rings(rows, ["session_id"]), ["session_id"], 1.0).isEmpty()
    assert outline.rings(rows.limit(0), ["session_id"]).isEmpty()


def test_random_masks_keep_their_facts(spark):
    rng = np.random.default_rng(5)
    masks = {k: rng.random((17, 23)) < p for k, p in enumerate((0.2, 0.5, 0.8))}
    got = outline.rings(table(spark, masks), ["session_id"]).toPandas()
    for k, mask in masks.items():
        mine, wide = got[got.session_id == k], np.pad(mask, 1)
        sign = np.where(mine.hole, -1, 1)
        assert (mine.pixels * sign).sum() == mask.sum()
        assert mine.sides.sum() == sum((np.diff(wide.astype(int), axis=a) != 0).sum() for a in (0, 1))
        assert (~mine.hole).sum() == kernels.label_components(mask)[1]


def test_outer_points_are_those_of_a_border_walk(spark):
    rng = np.random.default_rng(9)
    v, u = np.mgrid[:40, :40]
    mask = (np.hypot(v - 20, u - 19) < 14 + 3 * np.sin(5 * np.arctan2(v - 20, u - 19))) & (rng.random((40, 40)) < 0.97)
    comp, _ = kernels.label_components(mask)
    mine = comp == np.bincount(comp.ravel())[1:].argmax() + 1
    got = outline.largest(outline.rings(table(spark, {1: mine}), ["session_id"]), ["session_id"], 1.5).first()
    walked = kernels.simplify(kernels.trace(mine).astype(float), 1.5)
    assert set(points(got)) == {(int(a), int(b)) for a, b in walked}


def test_world_outline(spark):
    mask = np.zeros((30, 30), bool)
    mask[5:25, 10:20] = True
    grid = spark.createDataFrame([(1, 4.0, 6.0)], "session_id long, max_x double, max_z double")
    got = outline.in_world(table(spark, {1: mask}), grid, ["session_id"], 10.0).first()
    assert [(round(p.x, 6), round(p.z, 6)) for p in got.polygon] == [(3.0, 5.5), (2.1, 5.5), (2.1, 3.6), (3.0, 3.6)]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 65])
def test_ranks_of_rings_of_any_length(spark, n):
    ids = np.random.default_rng(n).permutation(1000)[:n].tolist()
    start = ids.index(min(ids))
    rows = spark.createDataFrame([(1, a, b) for a, b in zip(ids, ids[1:] + ids[:1])], "session_id int, id long, next long")
    got = {r.id: r["rank"] for r in outline.ranked(rows, ["session_id"]).collect()}
    assert got == {x: k for k, x in enumerate(ids[start:] + ids[:start])}

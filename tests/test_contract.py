"""Segmentation by contraction, in one piece and over tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import contract, kernels
from rasterloom.plans import catalog


def planes(h, w, noise, seed=0):
    """Four upright stripes, 30 cm apart, and a step across two of them."""
    v, u = np.indices((h, w))
    image = 2.4 + 0.3 * (u * 4 // w) + 0.6 * ((v > h // 2) & (u > w // 2))
    return image + np.random.default_rng(seed).normal(size=(h, w)) * noise


def partition(labels):
    return {frozenset(np.flatnonzero(labels.ravel() == x).tolist()) for x in np.unique(labels)}


def truth(h, w):
    return partition(np.round(planes(h, w, 0) * 10))


def pixels(spark, image, session=1, room=None):
    h, w = image.shape
    rows = [(session, u, v, None if np.isnan(image[v, u]) else float(image[v, u]), bool(room is None or room[v, u])) for v in range(h) for u in range(w)]
    return spark.createDataFrame(rows, "session_id long, u int, v int, y double, in_room boolean")


def labels(df, shape, session=1):
    out = np.full(shape, -2)
    for r in df.filter(F.col("session_id") == session).collect():
        out[r.v, r.u] = r.label
    return out


@pytest.mark.parametrize("noise", [0.0, 0.002])
@pytest.mark.parametrize("shape", [(40, 64), (90, 100)])
def test_planes_come_apart(noise, shape):
    assert partition(contract.whole(planes(*shape, noise), 200, 0, 30)) == truth(*shape)


def test_small_components_are_absorbed():
    image = planes(60, 60, 0)
    image[10:12, 5:7] = 9.0
    found = contract.whole(image, 1, 0, 30)
    assert len(np.unique(found)) == len(truth(60, 60)) and found[10, 5] == found[9, 5]
    assert len(np.unique(contract.whole(image, 1, 0, 1))) == len(truth(60, 60)) + 1


def test_absorbing_goes_by_cost():
    # 0-1 cost 3, 1-2 cost 1, 2-3 cost 2; with sizes 1 and a least of 3: 1-2, then 3, then 0
    a, b, cost = np.array([0, 1, 2]), np.array([1, 2, 3]), np.array([3.0, 1.0, 2.0])
    graph = contract.Graph(a, b, cost, np.arange(3), np.ones(4, np.int64), np.zeros(4))
    graph.absorb(3)
    assert len(set(graph.root.tolist())) == 1
    graph = contract.Graph(a, b, cost, np.arange(3), np.array([3, 1, 1, 5]), np.zeros(4))
    graph.absorb(3)
    assert graph.root[1] == graph.root[2] == graph.root[3] != graph.root[0]


def test_reach_takes_edges_in_order():
    # sizes 1, tolerance 1: 0.9 is within 1 / 1; 1.3 within 1 / 2 of it; 2.0 not within 1 / 3 of that
    graph = contract.Graph(np.array([0, 0, 0]), np.array([1, 2, 3]), np.array([0.9, 1.3, 2.0]), np.arange(3), np.ones(4, np.int64), np.zeros(4))
    reach = graph._reach(graph.a, graph.b, graph.cost, 1.0)
    assert reach.tolist() == [1.3, 0.9, -1.0, -1.0]


@pytest.mark.parametrize("tile", [16, 37, 200])
def test_tiles_give_the_labels_of_the_whole(spark, tile):
    image = planes(70, 64, 0.002)
    df = pixels(spark, image).unionByName(pixels(spark, planes(20, 20, 0), 2))
    got = contract.tiled(df, ["y"], 200, 0.0, 30, tile)
    assert partition(labels(got, image.shape)) == partition(contract.whole(image, 200, 0, 30)) == truth(70, 64)
    assert partition(labels(got, (20, 20), 2)) == truth(20, 20)


def test_halo_blurs_as_the_whole_does(spark):
    image = np.random.default_rng(2).random((30, 33))
    got = contract.tiled(pixels(spark, image), ["y"], 1e-9, 0.8, 1, 11)
    assert len(np.unique(labels(got, image.shape))) == image.size  # nothing is within that tolerance
    blurred = kernels.smooth(image, 0.8)
    rows = []

    def keep(pdf):
        made = contract._tile(pdf, "session_id", ["y"], 1e-9, 0.8, 1 << 20)
        return made[made.kind == 2]

    for v0 in range(0, 30, 11):
        for u0 in range(0, 33, 11):
            v, u = np.indices(image.shape)
            near = (abs(v - v0 - 5) <= 9) & (abs(u - u0 - 5) <= 9)
            mine = (v // 11 == v0 // 11) & (u // 11 == u0 // 11)
            import pandas as pd

            rows.append(keep(pd.DataFrame({"session_id": 1, "u": u[near], "v": v[near], "y": image[near], "mine": mine[near]})))
    told = {(r.x, r.y): r.cost for part in rows for r in part.itertuples()}
    a, b, cost = contract.edges(blurred[..., None], (np.indices(image.shape) * np.array([1 << 20, 1])[:, None, None]).sum(axis=0))
    expected = dict(zip(zip(a.tolist(), b.tolist(), strict=True), cost.tolist(), strict=True))
    assert set(told) == set(expected) and all(abs(told[k] - expected[k]) < 1e-12 for k in told)


def test_rooms_holes_and_merging(spark):
    image, room = planes(40, 48, 0), np.ones((40, 48), bool)
    room[:4] = False
    image[20, 3] = np.nan
    df = pixels(spark, image, room=room)
    apart = labels(contract.felzenszwalb(df, 5.0, 50, 0.0, tile=17), image.shape)
    assert (apart[:4] == -1).all() and set(np.unique(apart[4:])) == set(range(len(truth(40, 48))))
    joined = labels(contract.felzenszwalb(df, 5.0, 50, 0.0, 0.35, tile=17), image.shape)
    assert len(np.unique(joined[4:])) < len(np.unique(apart[4:]))
    assert contract.felzenszwalb(df.limit(0), 5.0).count() == 0


@pytest.mark.parametrize("name", ["tiled_felzenszwalb", "tiled_felzenszwalb_image", "tiled_felzenszwalb_combined"])
def test_registered_queries_label_every_pixel(spark, small, name):
    got, px = catalog.QUERIES[name](spark, small), catalog.scans(spark, small)
    assert got.count() == px.count() == got.select("session_id", "u", "v").distinct().count()
    assert got.join(px, ["session_id", "u", "v"]).filter("(label >= 0) <> in_room").isEmpty()

"""Closed-form periodic composites: battens, lattices and what the gates refuse."""

import numpy as np
import pytest

from rasterloom.operators import periodic

V, U = np.mgrid[:10, :60]


def pairs(spark, lower, upper, delta=0.1):
    rows = [(1, 0, 1, int(u), int(v), bool(lower[v, u]), bool(upper[v, u]), delta) for v, u in np.ndindex(lower.shape)]
    return spark.createDataFrame(rows, "session_id long, a int, b int, u int, v int, in_a boolean, in_b boolean, delta_y double")


def found(spark, upper, ppm=25.0):
    return periodic.composites(pairs(spark, ~upper, upper), ppm).collect()


def test_battens_are_linear(spark):
    (row,) = found(spark, U % 10 < 5, 75.0)
    assert row.kind == "linear" and abs(row.pitch_m - 10 / 75) < 1e-9 and abs(row.angle) == 180.0
    assert abs(row.strength - 50 / 60) < 1e-6 and row.turns == 11
    assert (row.only_a, row.only_b, row.delta_y) == (0.5, 0.5, 0.1)


def test_tiles_are_a_grid(spark):
    v, u = np.mgrid[:60, :60]
    (row,) = found(spark, (u % 8 < 2) | (v % 8 < 2))
    assert row.kind == "grid" and abs(row.pitch_m - 8 / 25) < 1e-9 and row.across >= 0.6 * row.strength


def test_correlations_are_those_of_the_definition(spark):
    box = np.random.default_rng(2).integers(-1, 2, (9, 11))
    rows = [(1, 0, 1, int(u), int(v), int(x)) for (v, u), x in np.ndenumerate(box)]
    got = periodic.correlogram(spark.createDataFrame(rows, "session_id long, a int, b int, u int, v int, value int"), 4).toPandas()
    rest = box - box.mean()
    wide = np.pad(rest, 20)
    assert len(got) == sum(du * du + dv * dv <= 16 for du in range(-4, 5) for dv in range(-4, 5))
    for r in got.itertuples():
        moved = wide[20 + r.dv : 29 + r.dv, 20 + r.du : 31 + r.du]
        assert abs(r.c - (rest * moved).sum() / (rest**2).sum()) < 1e-9


@pytest.mark.parametrize("case", ["far", "halves", "sparse", "flat", "noise", "narrow"])
def test_gates(spark, case):
    battens = U % 10 < 5
    lower, upper, delta = ~battens, battens, 0.1
    if case == "far":
        delta = 0.5
    elif case == "halves":
        lower, upper = U < 30, U >= 30
    elif case == "sparse":
        lower, upper = lower & (V < 4), upper & (V < 4)
    elif case == "flat":
        lower, upper = np.ones(U.shape, bool), np.zeros(U.shape, bool)
    elif case == "noise":
        upper = np.random.default_rng(4).random(U.shape) < 0.5
        lower = ~upper
    else:
        lower, upper = lower[:7], upper[:7]
    assert not periodic.composites(pairs(spark, lower, upper, delta), 25.0).collect()


def test_empty_tables(spark):
    none = pairs(spark, U < 0, U < 0).limit(0)
    assert periodic.composites(none, 25.0).isEmpty()

"""Nearest polygons against all edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import distance

POLY = "session_id long, region int, poly array<struct<u:double,v:double>>"


def plain(point, shapes):
    best = None
    for region, poly in shapes:
        for (au, av), (bu, bv) in zip(poly, poly[1:] + poly[:1], strict=True):
            du, dv = bu - au, bv - av
            size = du * du + dv * dv
            t = 0.0 if size == 0 else max(0.0, min(1.0, ((point[0] - au) * du + (point[1] - av) * dv) / size))
            x, y = point[0] - (au + t * du), point[1] - (av + t * dv)
            best = min(best or (math.inf, 0), (x * x + y * y, region))
    return best


@pytest.mark.parametrize("cell", [3, 16, 500])
def test_nearest_polygon_looks_at_every_edge_that_counts(spark, cell):
    rng = random.Random(cell)
    shapes = {s: [(k, [(rng.randrange(-40, 160) + rng.choice([0.0, 0.5]), rng.randrange(-40, 160) + 0.25) for _ in range(rng.randrange(1, 6))]) for k in range(7)] for s in (1, 2)}
    points = [(s, rng.randrange(-100, 220), rng.randrange(-100, 220)) for s in (1, 2, 3) for _ in range(150)]
    polygons = spark.createDataFrame([(s, k, p) for s, held in shapes.items() for k, p in held], POLY)
    df = spark.createDataFrame(points, "session_id long, u int, v int")
    got = {(r.session_id, r.u, r.v): (r.d2, r.region) for r in distance.nearest_polygon(df, polygons, cell).collect()}
    assert set(got) == {p for p in points if p[0] < 3}  # scan 3 has no polygon
    for (s, u, v), found in got.items():
        assert found == plain((float(u), float(v)), shapes[s])


def test_ties_go_to_the_main_then_the_lower_region(spark):
    square = lambda u: [(float(u), 0.0), (u + 4.0, 0.0), (u + 4.0, 4.0), (float(u), 4.0)]
    polygons = spark.createDataFrame([(1, 2, square(0)), (1, 1, square(8)), (1, 0, square(16)), (1, 3, square(16))], POLY)
    df = spark.createDataFrame([(1, 6, 2), (1, 14, 2), (1, 18, 9)], "session_id long, u int, v int")
    assert {r.u: r.region for r in distance.nearest_polygon(df, polygons).collect()} == {6: 1, 14: 0, 18: 0}
    assert distance.nearest_polygon(df, polygons).filter(distance.within(2.0)).count() == 2
    assert distance.nearest_polygon(df, polygons.filter(F.lit(False))).count() == 0

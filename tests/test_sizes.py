"""Work that must not grow faster than its input."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rasterloom import storage
from rasterloom.operators import distance, raster

POLY = "array<struct<u:int,v:int>>"


def plan_text(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def plain_fill(poly):
    """The pixels of one polygon, by the definition."""
    out, edges = set(), list(zip(poly, poly[1:] + poly[:1]))
    for (au, av), (bu, bv) in edges:
        n = max(abs(bu - au), abs(bv - av))
        out |= {(au + (2 * k * (bu - au) + max(n, 1)) // (2 * max(n, 1)), av + (2 * k * (bv - av) + max(n, 1)) // (2 * max(n, 1))) for k in range(n + 1)}
    for v in range(min(p[1] for p in poly), max(p[1] for p in poly) + 1):
        xs = sorted(au + (v - av) * (bu - au) / (bv - av) for (au, av), (bu, bv) in edges if (av <= v) != (bv <= v))
        for a, b in zip(xs[::2], xs[1::2]):
            out |= {(u, v) for u in range(int(min(a, b)) - 2, int(max(a, b)) + 2) if a <= u <= b}
    return out


def test_polygons_fill_without_sorting_pixels(spark):
    rng = random.Random(4)
    polys = {k: [(rng.randrange(-30, 30), rng.randrange(-30, 30)) for _ in range(1 + k % 6)] for k in range(120)}
    rows = [(k, p) for k, p in polys.items()] + [(0, polys[0]), (1, polys[3]), (500, []), (501, None)]
    made = raster.fill_polygons(spark.createDataFrame(rows, f"k int, poly {POLY}"))
    polys_of = {**{k: plain_fill(p) for k, p in polys.items()}, 1: plain_fill(polys[1]) | plain_fill(polys[3])}
    assert sorted(tuple(r) for r in made.select("k", "u", "v").collect()) == sorted((k, u, v) for k, px in polys_of.items() for u, v in px)
    text = plan_text(made)
    # the only group-by is that of polygons, below the pixels
    assert text.count("Aggregate [") == 1 and text.index("Generate explode") < text.index("Aggregate [")


@pytest.mark.parametrize("least", [8, 1, 0, -3])
def test_boxes_meet_in_squares(spark, least, monkeypatch):
    monkeypatch.setattr(raster, "MEET", 3)
    rng = random.Random(least)
    rows = []
    for k in range(150):
        u, v, w = rng.randrange(-20, 40), rng.randrange(40), rng.randrange(1, 40)
        rows += [(k % 3, 2 * k + d, rng.randrange(3), rng.randrange(9), u, v, u + w, v + 12) for d in range(2)]
    rows += [(0, 1000 + k, k % 2, 5, 3, 3, 20, 20) for k in range(12)]
    made = raster.region_pairs(spark.createDataFrame(rows, "session_id long, id long, cluster int, y int, u0 int, v0 int, u1 int, v1 int"), least)
    want = []
    for s, i, c, y, *p in rows:
        for t, j, d, z, *q in rows:
            both = (max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3]))
            if s == t and c != d and (y, i) < (z, j) and both[2] - both[0] >= least and both[3] - both[1] >= least:
                want.append((s, i, j, *both))
    assert sorted(tuple(r) for r in made.collect()) == sorted(want) and want


def test_boxes_alike_are_compared_once(spark):
    """4,000 regions in two classes: candidates are the pairs of the result, not all pairs of a scan."""
    rows = spark.range(4000).selectExpr("0L session_id", "id", "id % 2 cluster", "1 y", "cast(id % 2 * 500 as int) u0", "0 v0", "cast(id % 2 * 500 + 20 as int) u1", "20 v1")
    made = raster.region_pairs(rows)
    assert made.count() == 0
    assert "a_cluster" in plan_text(made) and "parts" in plan_text(made)


def test_shared_edges_go_once(spark):
    shapes = spark.createDataFrame([(0, k, [(0.0, 0.0), (4.0, 0.0), (2.0, 3.0)]) for k in range(50)], "session_id int, region int, poly array<struct<u:double,v:double>>")
    points = spark.createDataFrame([(0, u, v) for u in range(6) for v in range(6)], "session_id int, u int, v int")
    assert {r.region for r in distance.nearest_polygon(points, shapes).collect()} == {0}
    assert plan_text(distance.nearest_polygon(points, shapes)).count("min(region") >= 1


def test_saved_pixels_look_as_large_as_they_are(spark):
    """A table of 600,000 pixels is no candidate for a broadcast."""
    px = spark.range(600_000).select((F.col("id") / 10000).cast("long").alias("session_id"), (F.col("id") % 100).cast("int").alias("u"), (F.col("id") / 100 % 100).cast("int").alias("v"), F.lit(1).alias("label"))
    size = storage.save(px, "px")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 10_000_000


def test_pixels_are_never_broadcast_to_pixels(spark, monkeypatch):
    """Even where the input's file looks small."""
    from rasterloom.operators import segment

    plans, kept = [], segment.save
    monkeypatch.setattr(segment, "save", lambda df, *a, **k: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df, *a, **k))
    px = spark.range(400).select(F.lit(0).cast("long").alias("session_id"), (F.col("id") % 20).cast("int").alias("u"), F.expr("cast(id div 20 as int)").alias("v"), F.expr("2400 + 100 * cast(id % 20 div 10 as int)").alias("y"))
    made = segment.auto_detect(px, "y", 5, 20, 3, 10)
    assert made.count() == 400 and {r.region for r in made.collect()} == {0, 1}
    plans.append(made._jdf.queryExecution().sparkPlan().toString())
    assert not [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line and " u#" in line.split("BroadcastHashJoin")[1].split("],")[0]]


def test_sweep_moves_a_scan_once(spark, small):
    """Not once for each configuration, and no labels afterwards."""
    from rasterloom.operators import segment
    from rasterloom.plans import catalog

    text = plan_text(catalog.QUERIES["experiment_sweep"](spark, small))
    below = text[text.index("FlatMapGroupsInPandas", text.index("FlatMapGroupsInPandas") + 1) :]
    assert "Generate" not in below and "Join" not in below
    rows = catalog.scans(spark, small).filter("u < 30 and v < 30")
    runs = [e for e in catalog.EXPERIMENTS if e[0] in ("felzenszwalb_s200", "felz_merged_s200_3cm", "watershed_default", "slic_merge_n500_2cm")] + [("none", "unknown", {})]
    pick = lambda df: sorted((r.session_id, r.u, r.v, r.label) for r in df.collect())
    made = segment.sweep(rows, runs, 20.0)
    assert {r.name for r in made.select("name").distinct().collect()} == {name for name, _, _ in runs[:-1]}
    for name, algorithm, kwargs in runs[:-1]:
        assert pick(made.filter(F.col("name") == name)) == pick(segment.segment(rows, algorithm, 20.0, **kwargs))
    counts = segment.sweep_confusion(rows, runs, 20.0, "plane")
    held = made.join(rows, ["session_id", "u", "v"]).filter("label >= 0").groupBy("session_id", "name", F.col("label").alias("pred"), F.col("plane").alias("truth")).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, held.collect()))


def test_centres_far_away_are_not_compared():
    import numpy as np

    from rasterloom.operators import kernels

    rng = np.random.default_rng(6)
    v, u = np.mgrid[:90, :90].reshape(2, -1)
    for colours in (rng.integers(0, 256, (8100, 3)), np.repeat(u[:, None] // 30 * 60, 3, 1)):
        points = np.concatenate([colours, v[:, None] * 2.5, u[:, None] * 2.5], axis=1).astype(float)
        centres = points[rng.integers(0, 8100, 400)]  # some twice: the first of them wins
        want = np.concatenate([((part[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) for part in np.array_split(points, 8)])
        groups = kernels.boxes(points)
        assert sorted(np.concatenate([mine for mine, _, _ in groups]).tolist()) == list(range(8100))
        assert (kernels.nearest_centres(points, groups, centres) == want).all()


def test_a_scan_sorts_the_edges_of_an_image_once(monkeypatch):
    import numpy as np

    from rasterloom.operators import contract, kernels

    made, edges = [], contract.edges
    monkeypatch.setattr(contract, "edges", lambda *a: made.append(1) or edges(*a))
    y = np.random.default_rng(3).normal(2.4, 0.05, (30, 40))
    fresh = lambda: kernels.Scan(y, np.ones(y.shape, bool), np.zeros(y.shape, bool), np.zeros((*y.shape, 3)), 20.0)
    scan = fresh()
    got = [kernels.felzenszwalb(scan, scale) for scale in (100, 400, 100)] + [kernels.felzenszwalb_merged(scan, 400)]
    assert len(made) == 1
    want = [kernels.felzenszwalb(fresh(), scale) for scale in (100, 400, 100)] + [kernels.felzenszwalb_merged(fresh(), 400)]
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_composites_sort_a_bounded_number_of_pixels(spark, monkeypatch):
    """Pixels and moves go neither through a join's shuffle nor through a sorting aggregate; fields go to tasks by their size."""
    from rasterloom.operators import periodic

    monkeypatch.setattr(periodic, "ROWS", 2000, raising=False)
    plans, fields, kept, solve = [], [], periodic.save, periodic.correlogram
    monkeypatch.setattr(periodic, "save", lambda df, *a, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a, **k))
    monkeypatch.setattr(periodic, "correlogram", lambda field, *a, **k: fields.append(field) or solve(field, *a, **k))
    px = spark.range(24_000).selectExpr("id div 600 session_id", "0 a", "1 b", "cast(id % 60 as int) u", "cast(id div 60 % 10 as int) v", "id % 10 < 5 in_b", "0.1D delta_y")
    made = periodic.composites(px.withColumn("in_a", ~F.col("in_b")), 75.0)
    assert sorted((r.session_id, r.turns, r.kind) for r in made.collect()) == [(k, 11, "linear") for k in range(40)]
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    shuffled = [line for p in plans for line in p.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffled and not [line for line in shuffled if re.search(r"\bd?[uv]#", line)]
    assert not any("SortAggregate" in p for p in plans)
    (field,) = fields
    assert max(r["count"] for r in field.groupBy(F.spark_partition_id()).count().collect()) <= 3 * 2000


def test_slanted_peaks_find_their_line(spark):
    """Pixels and moves found by product and rounding are those of the line drawn step by step."""
    import numpy as np

    from rasterloom.operators import periodic

    v, u = np.mgrid[:40, :50]
    for k, upper in enumerate([(u + v) // 4 % 2 == 1, (2 * u + v) // 9 % 2 == 1, (u - 3 * v) // 12 % 2 == 1, (u % 7 < 3) | (v % 7 < 3)]):
        rows = [(k, 0, 1, int(a), int(b), not upper[b, a], bool(upper[b, a]), 0.0) for b, a in np.ndindex(upper.shape)]
        (row,) = periodic.composites(spark.createDataFrame(rows, "session_id long, a int, b int, u int, v int, in_a boolean, in_b boolean, delta_y double"), 25.0, least_turns=0).collect()
        c = periodic.kernels.autocorrelation(upper * 2.0 - 1).round(9)
        at = {(dv, du): c[40 + dv, 50 + du] for dv in range(-16, 17) for du in range(-16, 17) if dv * dv + du * du <= 256}
        dv, du = min((m for m in at if 9 <= m[0] ** 2 + m[1] ** 2 <= 225), key=lambda m: (-at[m], m))
        length = np.hypot(dv, du)
        line = [(20 + round(t * dv / length), 25 + round(t * du / length)) for t in range(-64, 65)]
        seen = [upper[p] for p in line if 0 <= p[0] < 40 and 0 <= p[1] < 50]
        across = [at[m] for r in range(3, 16) if (m := (round(r * du / length), round(-r * dv / length))) in at]
        assert abs(row.pitch_m * 25 - length) < 1e-9 and row.turns == sum(x != y for x, y in zip(seen, seen[1:]))
        assert abs(row.across - max(0, *across)) < 1e-8

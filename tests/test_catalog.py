"""Every registered query with SQL gives that SQL's rows; the others run."""

import pytest

from rasterloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, small, oracle, same, name):
    same(catalog.QUERIES[name](spark, small).toPandas(), oracle.execute(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", ["height_map", "height_clusters", "plan_json", "contour", "seg_histogram", "seg_watershed_multi", "seg_slic_merge", "hungarian_score"])
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    got = catalog.flagship(spark, small).toPandas()
    assert len(got) and got.loc[got.label == 0, "relative_y"].eq(0).all()


def test_auto_detect_tiles_the_scan(spark, small):
    px = catalog.pixels(spark, small)
    got = catalog.QUERIES["auto_detect"](spark, small)
    assert got.count() == px.count() == got.select("session_id", "u", "v").distinct().count()
    assert got.filter("region is null").isEmpty()


def test_band_merge_reads_the_whole_table(spark, small, oracle):
    got = catalog.QUERIES["band_merge_all"](spark, small).agg({"area": "sum"}).first()[0]
    assert got == oracle.execute("select sum(l_linenumber) from lineitem").fetchone()[0]


def test_sweep_ranks_the_whole_grid(spark, small):
    got = catalog.QUERIES["experiment_sweep"](spark, small).toPandas()
    scans = catalog.pixels(spark, small).select("session_id").distinct().count()
    assert len(got) == 37 * scans and set(got.algorithm) == set(catalog.segment.kernels.SEG)
    for _, one in got.groupby("session_id"):
        assert one["rank"].tolist() == list(range(1, 38)) and one["name"].nunique() == 37
        assert one.mean_iou.is_monotonic_decreasing

"""OBJ files read in splits and in parts, and the log of plan versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rasterloom.sources import plan_log, scans


def obj(seed, n=400):
    rng, out = random.Random(seed), ["mtllib x.mtl", "# note"]
    for _ in range(n):
        out.append(rng.choice(["v 1 2 3", "vt 0.5 0.25", "f 1 2 3", "f 1/2 3/4 5/6 7/8", "usemtl " + rng.choice("abcd"), "", "vn 1 0 0"]))
    return "\r\n".join(out[: n // 2]) + "\r\n" + "\n".join(out[n // 2 :]) + "\n"


def told(lines):
    key = lambda *cols: [F.element_at(F.split("file", "/"), -1).alias("file"), *cols]
    tables = {"v": scans.vertices(lines), "vt": scans.uvs(lines), "f": scans.faces(lines), "m": scans.materials(lines)}
    return {name: sorted(map(repr, df.select(*key(*df.columns[1:])).collect())) for name, df in tables.items()}


def test_splits_and_parts_change_nothing(spark, tmp_path, monkeypatch):
    for k in range(2):
        (tmp_path / f"{k}.obj").write_bytes(obj(k).encode())
    want = []
    for k in range(2):
        want += [(f"{k}.obj", i, line) for i, line in enumerate(obj(k).replace("\r\n", "\n").split("\n")[:-1])]
    whole = told(scans.read_lines(spark, str(tmp_path)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301b")
    try:
        lines = scans.read_lines(spark, str(tmp_path)).cache()
        assert lines.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        assert sorted((r.file.rpartition("/")[2], r.lineno, r.line) for r in lines.collect()) == sorted(want)
        monkeypatch.setattr(scans, "PART", 7)
        assert told(lines) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    mats = {r.mat for r in scans.faces(scans.read_lines(spark, str(tmp_path))).select("mat").distinct().collect()}
    assert mats <= {-1, 0, 1, 2, 3} and len(mats) > 3


def test_empty_lines_tables(spark):
    none = spark.createDataFrame([], "file string, lineno long, line string")
    assert scans.faces(none).count() == scans.vertices(none).count() == 0


def put(session, **what):
    def edit(plans):
        held = {r.session_id: json.loads(r.plan) for r in plans.collect()}
        made = json.dumps(held.get(session, {}) | what)
        return plans.sparkSession.createDataFrame([(session, made)], plan_log.PLANS)

    return edit


def plans(spark, root, **kw):
    return {r.session_id: json.loads(r.plan) for r in plan_log.latest(spark, root, **kw).collect()}


def test_versions_and_removal(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    assert plans(spark, root) == {} and plan_log.last_version(spark, root) == 0
    assert [plan_log.commit(spark, root, put("a", x=1)), plan_log.commit(spark, root, put("b", y=2)), plan_log.commit(spark, root, put("a", z=3))] == [1, 2, 3]
    assert plans(spark, root) == {"a": {"x": 1, "z": 3}, "b": {"y": 2}}
    assert plans(spark, root, version=2) == {"a": {"x": 1}, "b": {"y": 2}}
    gone = spark.createDataFrame([("b", None)], plan_log.PLANS)
    assert plan_log.commit(spark, root, lambda _: gone) == 4 and set(plans(spark, root)) == {"a"}


def test_two_writers_lose_no_edit(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    plan_log.commit(spark, root, put("a", n=0))
    calls = []

    def late(held):
        calls.append(1)
        made = put("a", mine=1)(held)
        if len(calls) == 1:  # another writer commits in between
            plan_log.commit(spark, root, put("a", theirs=2))
        return made

    assert plan_log.commit(spark, root, late) == 3 and len(calls) == 2
    assert plans(spark, root) == {"a": {"n": 0, "theirs": 2, "mine": 1}}
    with pytest.raises(plan_log.Conflict):
        plan_log.commit(spark, root, lambda held: [plan_log.commit(spark, root, put("b", k=1)), put("a", lost=1)(held)][1], tries=2)
    assert "lost" not in plans(spark, root)["a"]


def test_failed_write_leaves_the_old_plan(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    plan_log.commit(spark, root, put("a", n=1))
    with pytest.raises(Exception, match="broken"):
        plan_log.commit(spark, root, lambda held: held.withColumn("plan", F.raise_error(F.lit("broken")).cast("string")))
    assert plans(spark, root) == {"a": {"n": 1}} and plan_log.last_version(spark, root) == 1
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["v=00000001"]

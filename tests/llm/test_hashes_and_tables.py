"""Word hashes without structure, and tables that a worker builds once."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rasterloom.llm import common, decontam, jaccard, shingles


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_pattern_words_make_other_shingles(n):
    a, b = shingles.sets(pa.array([thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]))
    assert len(a) == len(b) == 1 and a[0] != b[0]


def test_pattern_words_do_not_link(spark):
    rows = [(k, thue_morse(1024, *pair)) for k, pair in enumerate(("ab", "ba", "xy", "AB"))]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0}


class Block:
    def __init__(self, value):
        self.value = value


def test_tables_are_built_once_for_many_tasks(monkeypatch):
    built = []

    class Counting(decontam.Items):
        def __init__(self, *args):
            built.append(1)
            super().__init__(*args)

    monkeypatch.setattr(decontam, "Items", Counting)
    monkeypatch.setattr(decontam, "_built", {})
    monkeypatch.setattr(decontam.F, "arrow_udf", lambda f, _: type("Udf", (), {"asNondeterministic": lambda self: f})())
    finders = [cloudpickle.dumps(decontam._finder(Block(((k, f"some words of item {k} that are long enough"),)), 0.25)) for k in range(decontam.KEPT)]
    for _ in range(5):  # a task unpickles its function anew and takes all blocks in turn
        for k, raw in enumerate(finders):
            got = cloudpickle.loads(raw)(pa.array([f"x some words of item {k} that are long enough y", None]))
            assert [[x["item_id"] for x in row] for row in got.to_pylist()] == [[k], []]
    assert len(built) == decontam.KEPT


def test_blocks_hold_their_bound(spark):
    rows = spark.createDataFrame([(k, "é" * (k % 7)) for k in range(30)] + [(99, "z" * 50), (100, None)], "id long, text string").orderBy("id")
    parts = list(common.blocks(rows, "text", 20))
    assert [r.id for p in parts for r in p] == [*range(30), 99, 100]
    assert all(len(p) == 1 or sum(len((r.text or "").encode()) for r in p) <= 20 for p in parts)


def test_many_blocks_find_what_one_does(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("__leaks0", F.lit("mine"))
    bench = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(5000, None), (5001, "")], "item_id long, text string"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    found = lambda **kw: {r.doc_id: sorted(tuple(x) for x in r.leaks) for r in decontam.with_leaks(docs, bench, **kw).filter("size(leaks) > 0").collect()}
    one, many = found(), found(block_bytes=size // 8)
    assert one and one == many
    assert decontam.with_leaks(docs, bench, block_bytes=size // 8).columns == [*docs.columns, "leaks"]


@pytest.mark.parametrize("share", [0.1, 0.25, 0.4])
@pytest.mark.parametrize("n", [16, 32, 60, 100])
def test_recall_follows_the_share(n, share):
    rng = random.Random(n)
    items = decontam.Items([(k, " ".join(f"w{rng.randrange(2000)}" for _ in range(n))) for k in range(60)], share)
    names = np.array(["", *items.vocabulary])
    texts = []
    for x in items.items:
        said = names[x].tolist()
        for p in rng.sample(range(n), int(n * share)):
            said[p] = f"other{rng.randrange(9999)}"
        texts.append(" ".join(["before"] * 30 + said + ["behind"] * 30))
    found = [{i for i, *_ in row} for row in items.leaks(texts)]
    assert sum(k in f for k, f in enumerate(found)) >= 0.9 * len(texts)


def test_other_shares_are_refused(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    with pytest.raises(ValueError, match="share|edits"):
        decontam.with_leaks(docs, bench, max_share=0.5)


def test_spent_tables_are_deleted(spark, small, tmp_path, monkeypatch):
    from rasterloom import storage
    from rasterloom.llm import phrases

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    made = [jaccard.near_duplicates(docs), phrases.collocations(docs)]
    assert sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir()) == ["op12-ranked", "op6-components"]
    assert made[0].count() == docs.count() and made[1].count() > 0
    with pytest.raises(ZeroDivisionError), storage.scratch(spark):
        storage.save(docs, "gone")
        raise ZeroDivisionError
    assert len(list(tmp_path.iterdir())) == 2

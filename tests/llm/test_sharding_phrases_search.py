"""Sharding, phrase collocations and ranked search against brute force and edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import phrases, queries, search, shards, words

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing column names."""
    rows = [(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "The WORD the word, " * 3000, "en"), (5, "x" * 20_000, "de"), (6, "Said it twice. Said it twice", "fr"), (6, "Said it twice. Said it twice", "fr"), (None, "no id at all", "en"), (7, "é😀 ÀÉ the the the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumn("__mark", F.lit(1)).withColumn("__place", F.lit("clash")).withColumn("n", F.lit(2.5)).withColumn("rank", F.lit(None).cast("int"))


def registered(name, spark, small, oracle, same):
    same(queries.queries()[name](spark, small).toPandas(), oracle.sql(queries.oracle_sql()[name]).df())


# --- words


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_words_hash_tells_patterns_apart():
    for n in (64, 512, 1024, 4096):
        got, _ = words.whole(pa.array([thue_morse(n, "a", "b"), thue_morse(n, "b", "a"), thue_morse(n, "A", "B")]), phrases.LETTERS)
        assert got[0] != got[1] and got[0] == got[2]


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
def test_words_are_the_same_in_any_chunks(monkeypatch, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("aB é.\n\t,c") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "z" * 99]
    monkeypatch.setattr(words, "CHUNK", chunk)
    said, last = defaultdict(list), None
    for some in words.chunks(pa.array(texts), phrases.LETTERS):
        spelled = some.spelled(np.arange(len(some))).to_pylist()
        for text, word, follows in zip(some.text.tolist(), spelled, some.follows.tolist(), strict=True):
            if follows:
                assert last == text
                said[text][-1].append(word)
            else:
                said[text].append([word])
            last = text
    for i, text in enumerate(texts):
        pieces = [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]
        assert said[i] == [p for p in pieces if p]


# --- op 11


def check_shards(got, n, of=24):
    rows = sorted((r.shard, r.slot) for r in got)
    sizes = Counter(s for s, _ in rows)
    assert rows == [(s, i) for s in sorted(sizes) for i in range(sizes[s])]
    sizes = [sizes[s] for s in range(of)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_sharding_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = queries.op11_sharding(spark, small).collect()
    check_shards(got, len(docs))
    assert {(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got} == {(d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode()), "rows", None) for d in docs}


def test_sharding_is_seeded_and_free_of_splits(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    place = lambda df, **kw: {r.doc_id: (r.shard, r.slot) for r in shards.shard(df, bucket_bytes=100_000, **kw).collect()}
    first = place(docs)
    assert first == place(docs.repartition(7).orderBy(F.desc("n_chars"))) and first != place(docs, seed=2)


def test_sharding_orders_buckets_by_fisher_yates(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows, buckets = shards._scattered(docs, 5, 100_000, "text", "m", "b")
    held = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.m):
        held[r.b].append(r.doc_id)
    expected = []
    for b in range(buckets):
        order, rng = list(held[b]), np.random.default_rng([5, b])
        picks = rng.integers(0, np.arange(len(order), 1, -1)) if len(order) > 1 else []
        for i, j in zip(range(len(order) - 1, 0, -1), picks, strict=True):
            order[i], order[j] = order[j], order[i]
        expected += order
    got = sorted(shards.shard(docs, seed=5, bucket_bytes=100_000).collect(), key=lambda r: (r.shard, r.slot))
    assert buckets > 3 and [r.doc_id for r in got] == expected


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(1)
    seen = Counter(tuple(shards.fisher_yates(4, rng).tolist()) for _ in range(12_000))
    assert len(seen) == 24 and sum((n - 500) ** 2 / 500 for n in seen.values()) < 60
    assert shards.fisher_yates(0, rng).tolist() == [] and shards.fisher_yates(1, rng).tolist() == [0]


def test_sharding_spreads_copies_and_keeps_odd_rows(spark, odd, tmp_path):
    got = shards.shard(odd).collect()
    check_shards(got, odd.count())
    assert {k: got[0][k] for k in ("__mark", "__place", "n")} == {"__mark": 1, "__place": "clash", "n": 2.5}
    assert shards.shard(odd.limit(0)).count() == 0
    copies = spark.range(0, 3000, 1, 3).selectExpr("if(id < 2000, 1, id) doc_id", "repeat('same ', 20) text")
    rows, buckets = shards._scattered(copies, 1, 30_000, "text", "m", "b")
    most = rows.groupBy("b").count().agg(F.max("count")).first()[0]
    assert buckets > 5 and most < 2 * 3000 / buckets
    made = shards.shard(copies, shards=7, bucket_bytes=30_000)
    check_shards(made.collect(), 3000, 7)
    shards.write(made, f"{tmp_path}/out")
    assert sorted(r.shard for r in spark.read.parquet(f"{tmp_path}/out").select("shard").distinct().collect()) == list(range(7))


# --- op 12


def plain_collocations(docs, least, top=2000, inside=80):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            said = re.findall(r"[^ \t]+", piece)
            total[lang] += len(said)
            counts[lang].update(tuple(said[i : i + k]) for k in range(1, 5) for i in range(len(said) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        part = lambda g: {g[i:j] for i in range(len(g)) for j in range(i + 2, len(g) + 1)} - {g}
        lost = {p for g, a in held.items() for p in part(g) if 100 * a >= inside * f[p]}
        best = []
        for g, a in held.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if g not in lost:
                best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, total[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


def collocated(docs, **kw):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(docs, **kw).collect())


@pytest.mark.parametrize("listed, split", [(1 << 20, 1 << 20), (5, 40), (1 << 20, 30), (0, 1)])
def test_collocations_equal_brute_force(spark, listed, split, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(phrases, "TOGETHER", 50)
    monkeypatch.setattr(phrases, "GATHERED", 400)
    vocabulary = ["the", "of", "a", "new", "York", "city", "é", "x-y", "B2", "of", "the"]
    rows = [(" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "", ",", ".\n"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows += [("new york city hall, the the the the the", "en")] * 40 + [(None, "en"), ("", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for least, top in ((5, 2000), (12, 20)):
        assert collocated(docs, least=least, top=top, listed=listed, split=split) == plain_collocations(rows, least, top)


def test_collocations_of_odd_rows(spark, odd):
    assert collocated(odd, least=2) == plain_collocations([(r.text, r.lang) for r in odd.collect()], 2)
    assert phrases.collocations(odd.limit(0)).count() == 0
    assert phrases.collocations(odd.filter("doc_id = 5")).count() == 0


def test_collocations_count_exactly_beyond_64_bits(spark):
    at, n = np.array([0, 1, 0]), np.array([2**52, 1, 2**52 + 1])
    assert phrases._whole_sums(at, n, 2).tolist() == [2**53 + 1, 1]


def test_collocations_query(spark, small, oracle, same):
    registered("op12_collocations", spark, small, oracle, same)


# --- op 13


def plain_search(docs, items, k):
    terms = lambda text: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    held = [(i, terms(t)) for i, t in docs if i is not None and terms(t)]
    n, total = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in sorted({x for x in items if x[0] is not None and x[1] is not None}):
        found = []
        for doc, said in held:
            tf, m = Counter(said), 25 + 75 * len(said) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m)) for w in terms(text) if tf[w])
            if score > 0:
                found.append((-score, doc))
        out += [(item, i + 1, doc, -s) for i, (s, doc) in enumerate(sorted(found)[:k])]
    return sorted(out)


def ranked(docs, items, **kw):
    return sorted(tuple(r) for r in search.search(docs, items, **kw).collect())


@pytest.mark.parametrize("window, block", [(1 << 13, 4_000_000), (8, 40), (1, 1)])
def test_search_equals_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(search, "WINDOW", window)
    rng = random.Random(3)
    vocabulary = ["the", "Of", "naïve", "42", "x_y", "日本", "rare", "zzz"] + [f"w{i}" for i in range(20)]
    say = lambda most: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(most)))
    docs = [(rng.choice([i, i * 10**12, -i]), say(30)) for i in range(120)] + [(7, "same same the rare")] * 40 + [(None, "rare"), (9, None), (10, " .,")]
    items = [(i, say(8)) for i in range(6)] + [(0, "rare rare zzz"), (0, "rare rare zzz"), (None, "rare"), (8, None), (9, "")]
    have = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumn("q", F.lit("clash"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    assert ranked(have, asked, k=5, block_bytes=block) == plain_search(docs, items, 5)


def test_search_of_odd_rows(spark, odd, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet").limit(3).unionByName(spark.createDataFrame([(-1, "twice the WORD é😀")], "item_id long, text string"))
    docs = odd.withColumn("doc", F.lit(1)).withColumn("window", F.lit("w"))
    assert ranked(docs, items) == plain_search([(r.doc_id, r.text) for r in odd.collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert search.search(odd.limit(0), items).count() == 0 and search.search(odd, items.limit(0)).count() == 0


def test_search_query(spark, small, oracle, same):
    registered("op13_lexical_search", spark, small, oracle, same)

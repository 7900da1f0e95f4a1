"""The text operators against libraries, brute force and edge cases."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import bpe, chat, decontam, graph, jaccard, lines, pii, quality, queries, suffix, topk

DOCS = "doc_id long, text string, source string, n long"


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and a clashing extra column."""
    rows = [(1, None, "a", 1), (2, "", None, 2), (3, " \n\t ", "a", 3), (4, "word " * 30_000, "b", 4), (5, "x" * 20_000, "b", 5), (6, "twice said", "a", 6), (6, "twice said", "a", 6), (None, "no id at all here today", "c", 7)]
    return spark.createDataFrame(rows, DOCS).withColumn("doc", F.lit("clash")).withColumn("__k", F.lit(1))


# --- op 1


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\a \\0 \\", "[INS", "", None, "[ROLE]x[AS]y[/ROLE]", "<s><s>[ANS]", "é\n😀"]
    roles = ["user", "assistant", "system", "tool[AS]", None]
    rng = random.Random(1)
    rows = [(c, t, rng.choice(roles), rng.choice(said)) for c in range(40) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    for r in got:
        mine = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(b.role, b.text) for b in r.back] == [m[1:] for m in mine]
        assert r.loss == "".join(m[2] for m in mine if m[1] == "assistant")


def test_chat_order_and_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "system", "s"), (3, 1, "user", "u"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    assert {r.conv_id: r.valid for r in chat.format_conversations(df).collect()} == {1: True, 2: False, 3: False, None: False}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_template_is_checked():
    bad = json.loads(json.dumps(chat.TEMPLATE))
    bad["begin"] = "<<s>"
    with pytest.raises(ValueError, match="mark"):
        chat.control_strings(bad)


# --- op 2 and 9


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library(library, text):
    vocabulary, counts, encoder = bpe._tables(bpe._raw(tokenizer()))
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.batch([text])[0].tolist() == ids
    assert sum(counts[w] for w in vocabulary.words(text)) == len(ids)


def test_bpe_odd_texts(spark, odd, library):
    path = tokenizer()
    made = bpe.count_tokens(bpe.decode(bpe.encode(odd, path), path), path).collect()
    assert len(made) == 8
    for r in made:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.n_tokens == len(r.ids) and r.doc == "clash"
    special = spark.createDataFrame([("a<|endoftext|><|endoftext|>b",)], "text string")
    assert bpe.encode(special, path).first().ids.count(50256) == 2
    assert bpe.count_tokens(special.limit(0), path).count() == 0
    holes = spark.createDataFrame([([1, None, 99999, 2],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(holes, path).collect()] == ['"#', ""]


def test_token_queries_equal_library(spark, small, oracle, library):
    texts = dict(oracle.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    made = queries.queries()["op9_bpe"](spark, small)
    assert len(re.findall(r"both\(", made._jdf.queryExecution().executedPlan().toString())) == 1
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in made.collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    for r in queries.queries()["op2_token_counts"](spark, small).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


# --- op 3


def test_line_dedup_brute_force(spark):
    rng = random.Random(2)
    pool = [f"line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own {i} {j}" for j in range(6)), f"s{rng.randrange(12)}", i) for i in range(60)]
    sites = {}
    for _, text, site, _ in rows:
        for x in text.split("\n"):
            sites.setdefault(x, set()).add(site)
    seen, expected = set(), {}
    for i, text, _, _ in rows:
        kept = []
        for x in text.split("\n"):
            if len(sites[x]) < 5 or x not in seen:
                kept.append(x)
            seen.add(x)
        expected[i] = "\n".join(kept)
    got = lines.dedup_lines(spark.createDataFrame(rows, DOCS), min_sites=5).collect()
    assert {r.doc_id: r.text for r in got} == expected


def test_line_dedup_edges(spark, odd):
    got = lines.dedup_lines(odd.withColumnRenamed("__k", "k"), min_sites=2, removed="gone").collect()
    assert len(got) == 8 and sum(r.gone for r in got) == 0 and {r.doc for r in got} == {"clash"}
    assert lines.dedup_lines(odd.limit(0).drop("__k")).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    rows = [(k, f"same line\nown {k}", f"s{k}", "d", 5) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __doc string, __hash long")
    got = sorted(tuple(r) for r in lines.dedup_lines(docs, removed="gone").select("doc_id", "text", "__doc", "__hash", "gone").collect())
    assert got == [(k, f"own {k}" if k else "same line\nown 0", "d", 5, int(k > 0)) for k in range(12)]


# --- op 4


VALUES = ["anna.b-7@mail3.example.com", "+1 (017) 555-7713", "4111 1111 1111 1111", "9807915762804490", "2024-02-29", "31/12/1999", "12/31/2020", "078-05-1120", "GB82 WEST 1234 5698 7654 32", "97.51.17.173", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']


@pytest.mark.parametrize("value", VALUES)
def test_pii_is_replaced_in_its_format_and_restored(value):
    f = pii.Feistel(b"k")
    new, spans = pii.replace(f"so {value} then {value}.", f)
    assert value not in new and len(spans) == 2
    first, second = (new[s["start"] : s["stop"]] for s in spans)
    assert first == second
    shape = [re.sub(r"[A-Za-z0-9]+", "x", x) for x in (first, value)]
    assert shape[0] in shape[1]
    assert pii.replace(new, f, back=True)[0] == f"so {value} then {value}."


@pytest.mark.parametrize("value", ["2023-02-29", "000-12-3456", "300.1.2.3", "GB00 WEST 1234 5698 7654 32", "version 2.0", "12345"])
def test_invalid_values_stay(value):
    assert pii.replace(value, pii.Feistel(b"k")) == (value, [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(2, 36), min_size=1, max_size=12), st.data())
def test_feistel_is_a_permutation(radices, data):
    digits = [data.draw(st.integers(0, r - 1)) for r in radices]
    f = pii.Feistel(b"key")
    image = f.permute("t", digits, radices)
    assert all(0 <= d < r for d, r in zip(image, radices)) and f.permute("t", image, radices, back=True) == digits


def test_small_domain_is_a_bijection():
    f = pii.Feistel(b"k")
    assert sorted(f.within("d", n, 300) for n in range(300)) == list(range(300))


def test_cards_stay_valid():
    f, rng = pii.Feistel(b"k"), random.Random(3)
    for _ in range(50):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        new, _ = pii.replace(body + str(pii.luhn_digit(body)), f)
        assert pii.luhn_digit(new[:-1]) == int(new[-1])


def test_card_before_another_number():
    f, rng = pii.Feistel(b"k"), random.Random(4)
    same = total = 0
    for _ in range(300):
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card = body + str(pii.luhn_digit(body))
        card = rng.choice([card, " ".join(card[i : i + 4] for i in range(0, 16, 4))])
        rest = rng.choice([" ", "-"]) + str(rng.randrange(1, 1000))
        text = f"card {card}{rest} times, card {card}."
        new, spans = pii.replace(text, f)
        assert pii.replace(new, f, back=True)[0] == text
        first, second = (new[s["start"] : s["stop"]] for s in spans)
        flat = re.sub(r"\D", "", card + rest)
        if pii.luhn_digit(flat[:-1]) != int(flat[-1]):  # else all of it is a card
            assert len(first) == len(card) and new[spans[0]["stop"] :].startswith(rest)
            same, total = same + (first == second), total + 1
        for other, kind in (("12/12/2020", "date"), ("12@mail.example.com", "email")):
            text = f"card {card} {other}, card {card}"
            new, spans = pii.replace(text, f)
            assert [s["kind"] for s in spans] == ["number", kind, "number"]
            assert new[spans[0]["start"] : spans[0]["stop"]] == new[spans[2]["start"] : spans[2]["stop"]]
            assert pii.replace(new, f, back=True)[0] == text
    assert same >= 0.8 * total
    text = "card 4111111111111111 12 times, then 4111 1111 1111 1111 on 4111111111111111 12/12/2020"
    new, spans = pii.replace(text, f)
    assert [s["kind"] for s in spans] == ["number", "number", "number", "date"]
    assert len({re.sub(r"\D", "", new[s["start"] : s["stop"]]) for s in spans[:3]}) == 1


def test_pii_edges(odd):
    got = pii.pseudonymize(odd, b"k").collect()
    assert len(got) == 8 and {r.doc for r in got} == {"clash"}
    assert [r.text for r in got if r.doc_id == 1] == [None] and pii.pseudonymize(odd.limit(0), b"k").count() == 0


# --- op 5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def leaks(text, items):
    said, out = decontam.words(text), []
    for k, item in items:
        w = decontam.words(item)
        n, best = len(w), None
        for s in range(len(said) - n + 1 if n else 0):
            d = levenshtein(w, said[s : s + n])
            if d <= n // 4 and (best is None or d < best[0]):
                best = (d, s)
        if best:
            out.append((k, best[0], n, best[1]))
    return sorted(out)


def test_decontamination_brute_force(spark):
    rng = random.Random(5)
    pool = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 5, 8, 14, 20, 30])))) for k in range(14)] + [(90, None), (91, "")]
    texts = []
    for i in range(60):
        said = [rng.choice(pool) for _ in range(rng.randrange(0, 60))]
        if i % 2:
            w = items[rng.randrange(14)][1].split()
            for _ in range(rng.randrange(0, len(w) // 4 + 2)):
                p = rng.randrange(len(w))
                w[p : p + rng.randrange(2)] = [rng.choice(pool)]
            said[len(said) // 2 : len(said) // 2] = w
        texts.append((i, " ".join(said).upper()))
    docs = spark.createDataFrame([*texts, (100, None), (101, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: sorted(tuple(x) for x in r.leaks) for r in decontam.with_leaks(docs, bench).collect()}
    expected = {i: leaks(t, [(k, x) for k, x in items if x]) for i, t in texts} | {100: [], 101: []}
    missed = sum(len(set(expected[i]) - set(got[i])) for i in expected)
    assert all(set(got[i]) <= set(expected[i]) or len(got[i]) == len(expected[i]) for i in got)
    assert missed <= 0.01 * sum(map(len, expected.values()))
    kept = decontam.decontaminate(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x} and kept.columns == ["doc_id", "text"]
    assert decontam.with_leaks(docs, bench.limit(0)).filter("size(leaks) > 0").isEmpty()


@pytest.mark.parametrize("n", [4, 6, 9, 15, 16, 24, 31, 45, 60, 130])
def test_lsh_recall_at_the_threshold(n):
    rng = random.Random(n)
    items = decontam.Items([(k, " ".join(f"w{rng.randrange(500)}" for _ in range(n))) for k in range(20)], 0.25)
    texts = []
    for x in items.items:
        w = x.tolist()
        for _ in range(n // 4):
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(2)] = rng.choice([[], [0], [rng.randrange(1, len(items.vocabulary) + 1)]])
        texts.append(np.array([0] * 20 + w + [0] * 20))
    found = items.candidates(texts)
    assert sum(k in f for k, f in enumerate(found)) >= 0.9 * len(texts)


@pytest.mark.parametrize("n", [8, 15, 20, 40, 80])
def test_lsh_rejects_unrelated_windows(n):
    rng = np.random.default_rng(n)
    items = decontam.Items([(k, " ".join(f"w{x}" for x in rng.integers(0, 300, n))) for k in range(20)], 0.25)
    for scale in items.scales.values():
        text = rng.integers(1, len(items.vocabulary) + 1, 500 * (scale.size + 1))
        starts = np.arange(500) * (scale.size + 1)
        text[starts + scale.size] = -1
        pairs = set()
        for key, whole in items.keys(scale, text, starts, starts + scale.size):
            for w in np.flatnonzero(whole & np.isin(key, scale.table)):
                k = np.searchsorted(scale.table, key[w])
                pairs |= {(int(w), scale.windows[o][0]) for o in scale.owner[scale.begin[k] : scale.begin[k + 1]]}
        assert len(pairs) < 0.05 * 500 * len(items.items)


def test_long_repeated_and_many_items(spark, monkeypatch):
    rng = random.Random(12)
    long = [f"v{rng.randrange(5000)}" for _ in range(20_000)]
    items = [(1, " ".join(long)), (2, "one two three four five six"), (3, "one two three four five six"), (2, "one two three four five six")]
    copy = [w for k, w in enumerate(long) if k % 11]
    rows = [(1, " ".join(["x"] * 30 + copy), "a"), (2, "say one two three four seven six", "b"), (2, "say one two three four seven six", "b"), (3, " ".join(copy[:9000]), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100_000)
    got = [(r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontam.with_leaks(docs, bench).collect()]
    assert sorted(got) == [(1, [1]), (2, [2, 2, 3]), (2, [2, 2, 3]), (3, [])]
    assert [(r.doc_id, r["__leaks"]) for r in decontam.decontaminate(docs, bench).collect()] == [(3, "c")]


def passage_distance(item, said):
    row = [0] * (len(said) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(said, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_dropped_and_inserted_words_cost_one_edit_each():
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(80)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (4, 7, 12, 16, 20, 40, 59)]
    texts = []
    for w in items:
        n = len(w)
        for edits in range(n // 4 + 2):
            for drop in (True, False):
                for around in (0, 15):
                    said = [x for k, x in enumerate(w) if not drop or k not in {n * (e + 1) // (edits + 1) for e in range(edits)}]
                    for e in reversed(range(0 if drop else edits)):
                        said.insert(n * (e + 1) // (edits + 1), rng.choice(pool))
                    texts.append([*rng.choices(pool, k=around), *said, *rng.choices(pool, k=around)])
    found = decontam.Items([(k, " ".join(w)) for k, w in enumerate(items)], 0.25)
    got = found.leaks([" ".join(x) for x in texts])
    beyond = 0
    for said, made in zip(texts, got, strict=True):
        true = {k: d for k, w in enumerate(items) if (d := passage_distance(w, said)) <= len(w) // 4}
        windows = {k: (d, s) for k, d, _, s in leaks(" ".join(said), [(k, " ".join(w)) for k, w in enumerate(items)])}
        assert {k for k, *_ in made} == set(true)
        for k, d, start in made:
            assert (d, start) == windows[k] if k in windows else d == true[k]
            assert k in windows or passage_distance(items[k], said[start:]) == d
        beyond += len(set(true) - set(windows))
    assert beyond > 20


# --- op 6


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (doc, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((doc, len(s), low[find(i)]) for i, (doc, s) in enumerate(sets))


def test_components_by_stars_and_in_one_task(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {tuple(r) for r in graph.components(df).collect()}
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert {tuple(r) for r in graph.components(df).collect()} == one
    assert {c for n, c in one if n >= 100} == {100}


@pytest.mark.parametrize("block, weight, miss", [(256, 10**6, jaccard.MISS), (5, 60, float("inf"))])
def test_near_duplicates_brute_force(spark, monkeypatch, block, weight, miss):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WEIGHT", weight)
    rng = random.Random(11)
    pool = [f"v{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(pool) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 30) + 1)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rows.append((len(rows), ("  " if g % 2 else "\t").join(w).title()))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs, miss=miss).collect())
    assert got == near(rows)
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {doc for doc, _, low in got if doc == low}


def test_near_duplicates_edges(spark, odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.near_duplicates(odd).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(6, 1)] == 6 and got[(None, 2)] is None
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("size", [80, 600, 3000])
def test_bound_never_hides_a_link(size):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64 - 1, size, np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[: size * (85 + k % 13) // 100], rng.integers(0, 2**64 - 1, size // 12, np.uint64)])) for k, s in enumerate(sets)]
    sets.sort(key=len)
    tree = jaccard.CountTree([jaccard.unpack(jaccard.pack(jaccard.group_counts(s))) for s in sets])
    every = np.ones(len(sets), bool)
    links = 0
    for i in range(len(sets)):
        expected = {j for j in range(i) if jaccard.linked(sets[i], sets[j])}
        links += len(expected)
        assert expected <= set(tree.search(i, every).tolist())
    assert links


@pytest.mark.parametrize("size", [200, 1000, 3000, 20_000])
def test_bound_rejects_unrelated_sets(size):
    rng = np.random.default_rng(2)
    tree = jaccard.CountTree([jaccard.group_counts(np.unique(rng.integers(0, 2**64 - 1, size, np.uint64))) for _ in range(60)])
    every = np.ones(60, bool)
    assert sum(len(tree.search(i, every)) for i in range(60)) < 0.05 * 60 * 59 / 2


def test_keep_one_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "other words here", "z")], "doc_id long, text string, __doc string")
    assert sorted(tuple(r) for r in jaccard.keep_one(docs).select("doc_id", "__doc").collect()) == [(1, "x"), (3, "z")]


# --- op 7


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    forest = quality.fit_arrays(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for row in x[:20]:  # one tree at a time gives the same
        raw = forest.base
        for at in forest.roots:
            for _ in range(forest.depth):
                at = forest.low[at] if row[forest.feature[at]] <= forest.cut[at] else forest.high[at]
            raw += forest.value[at]
        assert abs(1 / (1 + np.exp(-raw)) - forest.score(row[None])[0]) < 1e-12


def test_quality_held_out(spark, oracle, small):
    sf = small.replace("sf0.001", "sf0.01")
    got = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_edges(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.fit(odd, labels)
    assert {r.score for r in quality.score(odd, forest).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in quality.score(odd, quality.fit(odd, one)).collect())


def test_quality_query_brute_force(spark, small, oracle):
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    texts = dict(oracle.execute("select doc_id, text from documents").fetchall())
    labels = dict(oracle.execute("select doc_id, min(quality) from labels where quality is not null group by doc_id").fetchall())
    learnt = sorted((d, quality.features(texts[d])) for d in labels if d in texts and not fold(d))
    forest = quality.fit_arrays(np.array([x for _, x in learnt], float), np.array([labels[d] > 0 for d, _ in learnt], float))

    def walk(x):
        total = forest.base
        for node in forest.roots:
            while forest.low[node] != node:
                node = forest.low[node] if x[forest.feature[node]] <= forest.cut[node] else forest.high[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    got = queries.queries()["op7_quality"](spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == fold(r.doc_id) and abs(r.score - walk(quality.features(texts[r.doc_id]))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_quality_learns_repeated_rows_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one text", "s")] * 50 + [(2, "two", "s"), (4, "three", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_arrays", lambda x, y: seen.append(len(x)) or quality.Forest())
    assert quality.score(docs, quality.fit(docs, labels)).count() == 52
    assert seen[0] <= 3


# --- op 8


def test_top_k_brute_force_with_ties(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(700, 8)).round(1).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5]) for i in range(60)] + [(2000, None), (2100, [float("nan")] * 8), (2200, [1.0] * 3), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.top_k(df, block=3).collect())
    usable = [(i, np.floor(1024 * np.array(v))) for i, v in rows if i is not None and v is not None and np.isfinite(v).all()]
    expected = []
    for q, v in usable:
        if q % 100 == 0:
            scores = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])]
    assert got == sorted(expected)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_large_and_repeated(spark):
    rows = [(0, [3e12, 1.0]), (0, [3e12, 1.0]), (100, [2.0, 1.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, k=2, block=1).orderBy("query_id", "rank").collect()]
    q = [[int(1024 * x) for x in v] for _, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert got == [(0, 1, 1, dot(q[0], q[3])), (0, 2, 1, dot(q[0], q[3])), (100, 1, 0, dot(q[2], q[0])), (100, 2, 0, dot(q[2], q[0]))]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>")).collect()


# --- op 10


def repeats(rows):
    first, out = {}, []
    for doc, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], doc), doc)
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < doc:
                gone[k : k + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("share", [1024, 3])
def test_repeats_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(suffix, "SHARE", share)
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([20, 60, 200]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcdefghij ") for _ in range(30)) for _ in range(rng.randrange(0, 8)))) for i in range(80)]
    rows += [(200, "a" * 300), (201, "a" * 120), (202, None), (203, ""), (204, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash"))
    made = suffix.remove_repeats(df).select("doc_id", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert sorted(tuple(r) for r in made.collect()) == repeats(rows)


def test_repeats_edges(odd):
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == 8 and all(r.n_removed == 0 for r in got)
    assert suffix.remove_repeats(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.integers(1, 4))
def test_suffix_array_sorts(text, times):
    text = bytes(97 + b % 3 for b in text) * times
    order = suffix.suffix_array(np.frombuffer(text, np.uint8))
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


# --- registered queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, small, oracle, same, name):
    same(queries.queries()[name](spark, small).toPandas(), oracle.execute(queries.oracle_sql()[name]).df())

"""Blocks of texts cut from one template: each pair is compared once, prefixes stay short."""

import random

import numpy as np
import pytest

from rasterloom.llm import jaccard


def family(n: int, size: int = 200, own: int = 60) -> list[np.ndarray]:
    """Sets that share most items, but no two of them enough to link."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64 - 1, size - own, np.uint64)
    return [np.unique(np.concatenate([base, rng.integers(0, 2**64 - 1, own, np.uint64)])) for _ in range(n)]


def test_pairs_are_left_to_their_first_block():
    sets = family(3)
    sets.append(sets[0][:-1])
    sids, comps, seen = np.arange(4), np.arange(4), np.zeros(4, np.int64)
    here = lambda *tokens: np.array(tokens, np.int64).view(np.uint64)
    assert jaccard.link_block(sids, sets, comps, seen) == [(3, 0)]
    assert jaccard.link_block(sids, sets, comps, seen, [here(1), here(), here(), here(2)]) == [(3, 0)]
    assert jaccard.link_block(sids, sets, comps, seen, [here(1, 2**62 + 1), here(), here(), here(2**62 + 1)]) == []


@pytest.mark.parametrize("n", [3, 40])
def test_counts_by_bits_are_those_of_the_sets(n):
    sets = family(n)
    sets += [np.sort(np.random.default_rng(k).permutation(s)[: len(s) * (70 + k % 30) // 100]) for k, s in enumerate(sets)]
    bits = jaccard.repeated_bits(sets)
    for i, j in ((0, 1), (0, n), (1, n), (n, 2 * n - 1)):
        assert np.bitwise_count(bits[i] & bits[j]).sum() == len(np.intersect1d(sets[i], sets[j]))
    assert jaccard.repeated_bits(sets, 1) is None


def test_prefix_of_frequent_shingles_is_short():
    assert jaccard.prefix_length(400, 400) < 30 and jaccard.prefix_length(4000, 3990) < 50
    for size in (1, 4, 8, 50, 400):
        for hot in range(size + 1):
            assert 1 <= jaccard.prefix_length(size, hot) <= jaccard.prefix_length(size, hot, float("inf")) == size // 4 + 1


def test_a_template_that_links_by_chance(spark, monkeypatch):
    """Texts of one template in hundreds of common blocks, some of them copies, in small cells."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(60):
        w = list(base)
        for _ in range(1 + k % 5):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {doc: {tuple(t.split()[i : i + 5]) for i in range(116)} for doc, t in rows}
    low = {doc: doc for doc in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == low and 1 < len(set(low.values())) < 60

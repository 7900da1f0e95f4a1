"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A document leaks an item of n words if some passage of it, of whatever length, is
within word edit distance floor(n * ``max_share``) of the item (by default a quarter, which
is a similarity of 0.75 or more), so a dropped or inserted word costs one edit.  Words are runs of letters, digits and
underscores, lower-cased.

1. *Windows.*  Each item is cut into windows of a size that its length gives (a power of
   two up to ``SPAN``), overlapping by half; where the item has d edits, some window has
   no more than its share.  Windows of documents are looked at only where enough grams
   of any items of that size lie: a window of s words with e edits keeps
   s - q + 1 - q * e of its q-grams.  This mask doesn't say which item.
2. *CGK.*  ``WALKS`` random walks read a window: at each step a walk emits its word and
   moves on by a bit of a hash of (walk, step, word).  Walks of two texts fall into step
   again after an edit, so few edits leave many equal places (Hamming distance).
3. *Bit sampling.*  For each walk ``SETS`` sets of steps are drawn; the words emitted
   there are the key of a hash table of the items' windows.  A window with the same key
   in any table makes (item, start) a candidate.  Steps past the end of an item give no
   key, so that padding never agrees.  Measured: recall over 0.99 at the limit of
   edits from 15 words on, and at least 0.9 from 4 words on; under 5 % of unrelated
   windows are candidates (see the tests).
4. *Verification.*  From d words before to d words after a candidate start, semi-global
   edit distance (the whole item, ends free in the document) decides.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text (a longer item alone),
cut by a running sum; a larger benchmark takes more blocks, never a larger broadcast.  A
worker process builds a block's tables once, whatever number of tasks it runs.  ``KEPT``
blocks are looked at in one pass; the texts are written between passes.  Nothing is
shuffled.

Defined cases: null and empty texts and items leak nothing; repeated items are
reported each; a document reports each item once: the smallest distance of a window of
n words and the first such window, or where none is within the limit (shorter documents
too) the smallest distance of a passage of any length and the first start that has it;
other columns pass through.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import blocks, fresh, save

BLOCK_BYTES = 4_000_000
#: Blocks whose tables a process keeps, which is as many as one pass over the documents looks at.
KEPT = 3
#: The largest share of edits for which the tables were measured.
MOST_SHARE = 0.4
CELLS = 1 << 18  # words that are compared with an item at a time
#: Words of the largest window, walks, and sampled sets of steps for each walk.
SPAN, WALKS, SETS, SEED = 64, 12, 24, 20_240_229
#: Windows walked at a time.
WINDOWS = 1 << 14
_WORD = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


def edit_distances(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Edit distances of one item to the rows of ``windows``, row by row of the table."""
    places = np.arange(windows.shape[1] + 1)
    row = np.broadcast_to(places, (len(windows), len(places)))
    for i, symbol in enumerate(item):
        swap = row[:, :-1] + (windows != symbol)
        new = np.concatenate([np.full((len(windows), 1), i + 1), np.minimum(swap, row[:, 1:] + 1)], axis=1)
        row = np.minimum.accumulate(new - places, axis=1) + places
    return row[:, -1]


def passages(item: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance of the item to any passage of each row, and its first start."""
    wide = rows.shape[1] + 1
    places = np.arange(wide) * wide
    row = np.broadcast_to(np.arange(wide), (len(rows), wide))  # an edit counts wide, over every start
    for i, symbol in enumerate(item):
        swap = row[:, :-1] + wide * (rows != symbol)
        new = np.concatenate([np.full((len(rows), 1), (i + 1) * wide), np.minimum(swap, row[:, 1:] + wide)], axis=1)
        row = np.minimum.accumulate(new - places, axis=1) + places
    return np.divmod(row.min(axis=1), wide)


class Scale:
    """The hash tables of the item windows of one size."""

    def __init__(self, size: int, rng: np.random.Generator, max_share: float):
        self.size, self.edits = size, int(size * max_share)
        #: for each gram length, how many of its grams a window keeps at least
        self.least = {q: size - q + 1 - q * self.edits for q in (1, 2, 3) if size - q + 1 - q * self.edits > 0}
        self.steps = max(size, 3 * min(size, 8) // 2)  # a walk moves on at every second step
        picked = min(3, max(1, size.bit_length() - 1))  # steps in a set
        # one step from each of as many stretches
        self.sets = ((np.arange(picked) + rng.random((WALKS, SETS, picked))) * self.steps / picked).astype(np.int64)
        self.windows: list[tuple[int, int]] = []  # item, offset
        self.grams: dict[int, np.ndarray] = {}

    def build(self, items: Items) -> None:
        keys, owners = [], []
        for part in range(0, len(self.windows), WINDOWS):
            some = self.windows[part : part + WINDOWS]
            text = np.stack([items.items[i][o : o + self.size] for i, o in some])
            text = np.concatenate([text, np.full((len(some), 1), -1)], axis=1)
            starts = np.arange(len(some)) * (self.size + 1)
            for key, whole in items.keys(self, text.ravel(), starts, starts + self.size):
                keys.append(key[whole])
                owners.append(part + np.flatnonzero(whole))
        key, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owners))
        pairs = np.unique(np.stack([key, owner], axis=1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
        self.table, self.begin = np.unique(pairs[:, 0], return_index=True)
        self.begin, self.owner = np.append(self.begin, len(pairs)), pairs[:, 1]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.table & 0xFFFFF] = True


class Items:
    """A block of benchmark items with the tables of their windows."""

    def __init__(self, rows: list[tuple[int | None, str | None]], max_share: float):
        self.ids, self.vocabulary = [], {}
        self.items: list[np.ndarray] = []
        self.edits: list[int] = []
        rng, self.scales = np.random.default_rng(SEED), {}
        for item_id, text in rows:
            said = words(text)
            if not said:
                continue
            n = len(said)
            self.ids.append(item_id)
            self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in said], np.int64))
            self.edits.append(int(n * max_share))
            size = min(SPAN, 1 << (n.bit_length() - 1))
            scale = self.scales.setdefault(size, Scale(size, rng, max_share))
            scale.windows += [(len(self.items) - 1, o) for o in sorted({*range(0, n - size, max(1, size // 2)), n - size})]
        # the walks' bits, by word and step
        lanes = -(-3 * SPAN // 2 // 64)
        self.bits = rng.integers(0, 2**63, (WALKS, lanes, len(self.vocabulary) + 1), np.uint64) ^ (rng.integers(0, 2, (WALKS, lanes, len(self.vocabulary) + 1), np.uint64) << np.uint64(63))
        self.salt = rng.integers(1, 2**62, (WALKS, SETS), np.int64) | 1
        for scale in self.scales.values():
            owners = {i for i, _ in scale.windows}
            scale.grams = {q: np.unique(np.concatenate([self._gram(self.items[i], q) for i in owners])) for q in scale.least}
            scale.build(self)

    def _gram(self, symbols: np.ndarray, q: int) -> np.ndarray:
        key = np.zeros(max(0, len(symbols) - q + 1), np.int64)
        for i in range(q):
            key = key * (1 << 20) + symbols[i : len(key) + i]
        return key

    def keys(self, scale: Scale, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """For each table, the keys of the windows and which have one.

        Known words of a window that reach a table's steps make its key; ``text`` has a
        place behind the last window, and ``ends`` are where windows must stop.
        """
        shape = WALKS, len(starts)
        at = np.broadcast_to(starts, shape).copy()
        said = np.empty((scale.steps, *shape), np.int32)
        walk = np.arange(WALKS)[:, None]
        for t in range(scale.steps):
            symbol = text[at]
            said[t] = symbol
            bit = self.bits[walk, t // 64, np.maximum(symbol, 0)] >> np.uint64(t % 64) & np.uint64(1)
            at = np.minimum(at + bit.astype(np.int64), ends)
        for w in range(WALKS):
            for k in range(SETS):
                key, whole = np.full(len(starts), self.salt[w, k]), np.ones(len(starts), bool)
                for t in scale.sets[w, k]:
                    symbol = said[t, w].astype(np.int64)
                    whole &= symbol > 0
                    key = (key ^ symbol) * 0x2545F4914F6CDD1D
                yield (key ^ (key >> 29)) & 0x7FFFFFFFFFFFFFFF, whole

    def windows(self, scale: Scale, symbols: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold enough known grams."""
        fit = np.ones(len(symbols), bool)
        for q, least in sorted(scale.least.items(), reverse=True):
            gram, known = self._gram(symbols, q), scale.grams[q]
            hit = known[np.minimum(np.searchsorted(known, gram), len(known) - 1)] == gram
            if np.count_nonzero(hit) < least:
                return np.zeros(0, np.int64)
            many = np.concatenate([[0], np.cumsum(hit)])
            begin = np.minimum(np.arange(len(symbols)), len(gram))
            fit &= many[np.minimum(begin + scale.size + scale.edits - q + 1, len(gram))] - many[begin] >= least
        return np.flatnonzero(fit)

    def candidates(self, texts: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
        """By text, the starts where each item may leak: those that a table gives and their surroundings."""
        out: list[dict[int, list]] = [defaultdict(list) for _ in texts]
        for scale in self.scales.values():
            found = [self.windows(scale, x) for x in texts]
            rows = np.repeat(np.arange(len(texts)), [len(x) for x in found])
            if not len(rows):
                continue
            used = np.unique(rows)
            sizes = np.array([len(texts[r]) + 1 for r in used])
            base = np.zeros(len(texts), np.int64)
            base[used] = np.cumsum(sizes) - sizes
            flat = np.concatenate([np.append(texts[r], -1) for r in used])
            local = np.concatenate(found)
            last = base + np.array([len(x) for x in texts])
            for part in range(0, len(rows), WINDOWS):
                row, begin = rows[part : part + WINDOWS], local[part : part + WINDOWS]
                hits = []
                for key, whole in self.keys(scale, flat, base[row] + begin, last[row]):
                    mine = np.flatnonzero(whole & scale.maybe[key & 0xFFFFF])
                    k = np.minimum(np.searchsorted(scale.table, key[mine]), len(scale.table) - 1)
                    ok = scale.table[k] == key[mine]
                    mine, k = mine[ok], k[ok]
                    many = scale.begin[k + 1] - scale.begin[k]
                    at = np.repeat(scale.begin[k] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    hits.append(np.unique(np.repeat(mine, many) * len(scale.windows) + scale.owner[at]))
                for hit in np.unique(np.concatenate(hits)).tolist():
                    w, owner = divmod(hit, len(scale.windows))
                    item, offset = scale.windows[owner]
                    out[row[w]][item].append(int(begin[w]) - offset)
        return [{i: self._around(i, np.array(starts), len(x)) for i, starts in found.items() if len(x) >= len(self.items[i]) - self.edits[i]} for found, x in zip(out, texts, strict=True)]

    def _around(self, item: int, starts: np.ndarray, total: int) -> np.ndarray:
        d = self.edits[item]
        near = (np.unique(starts)[:, None] + np.arange(-d, d + 1)).ravel()
        return np.unique(np.clip(near, 0, total - len(self.items[item]) + d))

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(item, distance, start) of each text's leaks."""
        get = self.vocabulary.get
        jobs = defaultdict(list)
        known = [np.fromiter(map(get, said, repeat(0)), np.int64, len(said)) for said in map(words, texts)]
        for row, found in enumerate(self.candidates(known)):
            for i, begin in found.items():
                jobs[i].append((row, begin, known[row]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i in sorted(jobs):
            for (row, begin, symbols), (d, b) in zip(jobs[i], self._nearest(i, jobs[i]), strict=True):
                if d > self.edits[i]:
                    continue
                n = len(self.items[i])
                begin = begin[begin <= len(symbols) - n]
                best = []
                step = max(1, CELLS // n)
                for part in range(0, len(begin), step):
                    cut = begin[part : part + step]
                    far = edit_distances(self.items[i], symbols[cut[:, None] + np.arange(n)])
                    k = int(far.argmin())
                    best.append((int(far[k]), int(cut[k])))
                window = min(best, default=(n, 0))
                out[row].append((i, *(window if window[0] <= self.edits[i] else (d, b))))
        return out

    def _nearest(self, item: int, jobs: list) -> list[tuple[int, int]]:
        """(distance, start) of each job's passage nearest to the item."""
        n, d = len(self.items[item]), self.edits[item]
        regions = []
        for k, (_, begin, symbols) in enumerate(jobs):
            cut = np.flatnonzero(np.diff(begin) > n)
            for first, last in zip(begin[np.r_[0, cut + 1]].tolist(), begin[np.r_[cut, len(begin) - 1]].tolist(), strict=True):
                regions.append((k, first, symbols[first : last + n + d]))
        regions.sort(key=lambda r: len(r[2]))
        best = [(n + 1, 0)] * len(jobs)
        while regions:
            part = [regions.pop()]  # the longest is the first
            wide = len(part[0][2])
            while regions and (len(part) + 1) * wide <= CELLS and 2 * len(regions[-1][2]) > wide:
                part.append(regions.pop())
            rows = np.full((len(part), wide), -1, np.int64)
            for row, (*_, said) in zip(rows, part, strict=True):
                row[: len(said)] = said
            for (k, first, _), far, at in zip(part, *map(np.ndarray.tolist, passages(self.items[item], rows)), strict=True):
                best[k] = min(best[k], (far, first + at))
        return best


LEAKS = "array<struct<item_id:bigint,distance:int,n_words:int,start:int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("start", pa.int32())]))
#: The tables that this process has built, by block.  Only functions found by name share it between tasks.
_built: dict[str, Items] = {}


def _items(name: str, block, max_share: float) -> Items:
    if name not in _built:
        while len(_built) >= KEPT:
            _built.pop(next(iter(_built)))
        _built[name] = Items(list(block.value), max_share)
    return _built[name]


def _leaks(name: str, block, max_share: float, texts: pa.Array) -> pa.Array:
    items = _items(name, block, max_share)
    got = items.leaks(texts.to_pylist())
    return pa.array([[{"item_id": items.ids[i], "distance": d, "n_words": len(items.items[i]), "start": b} for i, d, b in row] for row in got], _ARROW)


def _finder(block, max_share: float):
    name = uuid.uuid4().hex

    def find(texts: pa.Array) -> pa.Array:
        return _leaks(name, block, max_share, texts)

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(find, LEAKS).asNondeterministic()  # else a filter on its result runs it twice


def with_leaks(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.25, text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "leaks", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` plus an array of the benchmark items that each text leaks; a column of that name is replaced."""
    if not 0 <= max_share <= MOST_SHARE:
        raise ValueError(f"the tables find passages with up to {MOST_SHARE} of an item's words as edits")
    rows = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).filter("text is not null")
    made, columns, names = docs, [], []
    for k, block in enumerate(blocks(rows.orderBy("id", "text"), "text", block_bytes)):
        got = tuple(sorted(((r.id, r.text) for r in block), key=repr))
        if k and k % KEPT == 0:  # what a process keeps serves one pass
            made = save(made.select("*", *(c.alias(n) for c, n in zip(columns, names[-len(columns) :], strict=True))), "op5-pass")
            columns = []
        columns.append(_finder(docs.sparkSession.sparkContext.broadcast(got), max_share)(F.col(text)))
        names.append(fresh(f"__leaks{k}", docs))
    if not names:
        return docs.withColumn(out, F.array().cast(LEAKS))
    made = made.select("*", *(c.alias(n) for c, n in zip(columns, names[-len(columns) :], strict=True)))
    return made.withColumn(out, F.concat(*names) if len(names) > 1 else F.col(names[0])).drop(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    leaks = fresh("__leaks", docs)
    return with_leaks(docs, benchmark, out=leaks, **kwargs).filter(F.size(leaks) == 0).drop(leaks)

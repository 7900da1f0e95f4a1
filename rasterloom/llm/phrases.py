"""Phrase collocations by pivot partitioning of rewritten text fragments.

A phrase is a run of 2 to 4 words inside a piece of text; everything is counted by
language.  A phrase that occurs ``least`` times and more is a candidate.

1. *Words.*  Tasks count words, the sums give each language's frequent words (``least``
   and more; no other word is part of a candidate) and its number of words.  The most
   frequent ones, at most ``LISTED``, are ranked and broadcast (20 bytes each).
2. *Routing.*  A phrase belongs to its pivot: its rarest word, of equal ones the leftmost.
   Around each word the text is rewritten for it as pivot: three words to each side, up
   to the end of the piece, an infrequent word or a rarer one (on the left also the pivot
   itself).  Equal fragments of a task are counted, sorted, packed and sent to the cell of
   their pivot.  Pivots with over ``SPLIT`` occurrences are dealt over several cells.
3. *Mining.*  A cell grows phrases from the pivot outwards, to the right and to the left,
   only where the shorter phrase is a candidate, and emits those that its pivots own: each
   phrase comes from one cell, or of split pivots as partial counts that are summed.
4. *Scores.*  Every part of a candidate is one too or a word, so that one join of the
   candidates with their own parts gives the counts of all cuts, and one aggregate the
   longer candidates that a phrase lies in.

Where frequent words are more than ``LISTED``, the rest stand for themselves by hash, as
rarer than all listed ones; infrequent words among them then travel too and are left out
by their counts.  Results are the same.

Defined cases: a null text has no words; a null language is ``und``; repeated rows count
each; a language without candidates has no rows; other columns are ignored.  Two words of
one language count as one if their 64-bit hashes agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import mix64, save, scratch
from rasterloom.llm.words import Letters, Words, chunks

#: Words between blanks and tabs, in pieces that punctuation or a line break ends.
LETTERS = Letters.between(b" \t", b".,;:!?\n\x0b\x0c\r")
#: Words of the longest phrase.
LONGEST = 4
#: Words in the broadcast list; entries of a task's table of words.
LISTED, TABLE = 1 << 20, 400_000
#: Fragments gathered before they are packed; words whose fragments are made together.
GATHERED, TOGETHER = 1 << 20, 1 << 18
#: Words of text for each cell, and occurrences of a pivot in one cell.
CELL, SPLIT = 1 << 22, 1 << 20
#: Rows of each language that one task ranks first.
SPREAD = 32


def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """(words, their keys, languages by text) for chunk after chunk; a key stands for a word of a language."""
    langs = batch.column("lang").to_pylist()
    known = {x: _lang_key(x) for x in set(langs)}
    salt = np.array([known[x] for x in langs], np.uint64)
    for some in chunks(batch.column("text"), LETTERS):
        keys = mix64(some.hash ^ salt[some.text])
        keys[keys == np.uint64(2**64 - 1)] = 0  # that value marks a missing word
        yield some, keys, langs


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, where each is first, sums of n)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return ranked[first], order[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


class _Table:
    """A task's counts by word, in bounded memory."""

    def __init__(self):
        self.keys, self.n, self.langs, self.words = [], [], [], []
        self.size = 0

    def add(self, some: Words, keys: np.ndarray, langs: list[str]) -> None:
        keys, first, n = _sums(keys, np.ones(len(keys), np.int64))
        self.keys.append(keys)
        self.n.append(n)
        self.langs.append(pa.array(langs, pa.large_string()).take(pa.array(some.text[first])))
        self.words.append(some.spelled(first))
        self.size += len(keys)

    def fold(self) -> None:
        keys, first, n = _sums(np.concatenate(self.keys), np.concatenate(self.n))
        at = pa.array(first)
        self.langs, self.words = ([pa.concat_arrays(x).take(at)] for x in (self.langs, self.words))
        self.keys, self.n, self.size = [keys], [n], len(keys)

    def rows(self) -> pa.RecordBatch:
        names = ["lang", "key", "word", "n"]
        return pa.RecordBatch.from_arrays([self.langs[0].cast(pa.string()), pa.array(self.keys[0].view(np.int64)), self.words[0].cast(pa.string()), pa.array(self.n[0])], names)


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, key, word, n): each task's words; with null key and word all words of the language."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, every = _Table(), {}
        for batch in batches:
            for some, keys, langs in _keys(batch):
                if not len(some):
                    continue
                table.add(some, keys, langs)
                for text, n in zip(*np.unique(some.text, return_counts=True), strict=True):
                    every[langs[text]] = every.get(langs[text], 0) + int(n)
                if table.size > TABLE:
                    table.fold()
                    if table.size > TABLE // 2:
                        yield table.rows()
                        table = _Table()
        if table.size:
            table.fold()
            yield table.rows()
        none = pa.nulls(len(every), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), none, none.cast(pa.string()), pa.array(list(every.values()), pa.int64())], ["lang", "key", "word", "n"])

    return rows.mapInArrow(scan, "lang string, key long, word string, n long")


class Ranks:
    """The listed words: a smaller rank is a more frequent word."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, complete: bool):
        order = np.lexsort((keys, -n))
        self.keys, self.n, self.complete = keys[order], n[order], complete
        self.order = np.argsort(self.keys)
        self.sorted = self.keys[self.order]

    def _rank(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.keys) - 1)
        return self.sorted[at] == keys, self.order[at]

    def codes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what stands for each word, its place in the order of rarity); -1 for words that no candidate holds."""
        known, rank = self._rank(keys)
        if self.complete:
            code = np.where(known, rank, -1).astype(np.int32)
            return code, code
        return keys.view(np.int64), np.where(known, rank, len(self.keys) + (keys >> np.uint64(2)).astype(np.int64))

    def parts(self, code: np.ndarray, split: int) -> np.ndarray:
        """Over how many cells each pivot's fragments go."""
        if self.complete:
            return -(-self.n[code] // split)
        known, rank = self._rank(code.view(np.uint64))
        out = np.ones(len(code), np.int64)
        out[known] = -(-self.n[rank[known]] // split)
        return out

    def named(self, code: np.ndarray) -> np.ndarray:
        return self.keys[code].view(np.int64) if self.complete else code


def padded(x: np.ndarray, fill: int) -> np.ndarray:
    ends = np.full(LONGEST - 1, fill, x.dtype)
    return np.concatenate([ends, x, ends])


def fragments(codes: np.ndarray, places: np.ndarray, joined: np.ndarray, low: int, high: int) -> np.ndarray:
    """Columns pivot, right 1 to 3, left 1 to 3 of the words from ``low`` to ``high`` that have neighbours.

    The arrays are padded; -1 where the fragment has ended.
    """
    n, side = high - low, LONGEST - 1
    at = side + low
    order = places[at : at + n]
    out = np.full((2 * side + 1, n), -1, codes.dtype)
    out[0] = codes[at : at + n]
    for row, way in ((1, 1), (1 + side, -1)):
        open_ = order >= 0
        for d in range(side):
            to = at + way * (d + 1)
            link = to if way > 0 else to + 1
            place = places[to : to + n]
            open_ = open_ & joined[link : link + n] & (place >= 0) & ((place <= order) if way > 0 else (place < order))
            out[row + d][open_] = codes[to : to + n][open_]
    return out[:, (out[1] != -1) | (out[1 + side] != -1)]


_MIX = np.random.default_rng(20_250_612).integers(0, 2**63, 2 * LONGEST, np.uint64) | np.uint64(1)


def merged(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal columns of ``rows`` as one, with summed counts, and a hash of each."""
    total = np.zeros(rows.shape[1], np.uint64)
    for row, odd in zip(rows, _MIX, strict=False):
        total += (row.astype(np.int64).view(np.uint64) + np.uint64(7)) * odd
    mark = mix64(total)
    order = np.argsort(mark)
    rows, n, mark = rows[:, order], n[order], mark[order]
    new = np.ones(len(n), bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)  # rows whose hashes agree by chance stay apart
    first = np.flatnonzero(new)
    return rows[:, first], np.add.reduceat(n, first) if len(first) else n, mark[first]


def pack(rows: np.ndarray, n: np.ndarray) -> bytes:
    return bytes([rows.dtype.itemsize]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(rows).tobytes() + n.astype(np.int64).tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = raw[0]
    held = zstandard.ZstdDecompressor().decompress(raw[1:])
    many = len(held) // (wide * (2 * LONGEST - 1) + 8)
    cut = wide * (2 * LONGEST - 1) * many
    return np.frombuffer(held[:cut], f"i{wide}").reshape(2 * LONGEST - 1, many), np.frombuffer(held[cut:], np.int64)


def _routed(rows: DataFrame, ranks, cells: int, split: int) -> DataFrame:
    """(cell, packed): the counted fragments of each task, by the cell of their pivot."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = ranks.value, [], 0

        def send(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            found, n, mark = merged(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))
            many = known.parts(found[0], split).astype(np.uint64)
            cell = mix64(found[0].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (mark >> np.uint64(7)) % many) % np.uint64(cells)
            order = np.lexsort((found[4], found[1], found[0], cell))
            found, n, cell = found[:, order], n[order], cell[order].astype(np.int64)
            to, first = np.unique(cell, return_index=True)
            last = np.append(first[1:], len(cell))
            blobs = [pack(found[:, a:b], n[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to), pa.array(blobs, pa.binary())], ["cell", "packed"])

        for batch in batches:
            read = [(known.codes(keys), some.follows) for some, keys, _ in _keys(batch)]
            if not read:
                continue
            codes, places = (padded(np.concatenate([r[0][k] for r in read]), -1) for k in (0, 1))
            joined = padded(np.concatenate([r[1] for r in read]), 0)
            n = len(codes) - 2 * (LONGEST - 1)
            for low in range(0, n, TOGETHER):
                found = fragments(codes, places, joined, low, min(n, low + TOGETHER))
                held.append((found, np.ones(found.shape[1], np.int64)))
                size += found.shape[1]
                if size >= GATHERED:
                    found, many, _ = merged(np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held]))
                    held, size = [(found, many)], len(many)
                    if size >= GATHERED // 2:
                        yield send(held)
                        held, size = [], 0
        if size:
            yield send(held)

    return rows.mapInArrow(scan, "cell long, packed binary")


def mine(rows: np.ndarray, n: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(phrases by column, a, a row of each) of all phrases that hold the pivot and reach ``least``, given by row.

    Rows are fragments, ``n`` their counts.
    """
    side = LONGEST - 1
    every = np.arange(rows.shape[1])
    # by (words left, words right) of the pivot: fragments that have the phrase, its number, its words
    level = {(0, 0): (every, np.unique(rows[0], return_inverse=True)[1], rows[:1])}
    for size in range(2, LONGEST + 1):
        grown = {}
        for left in range(size):
            right = size - 1 - left
            shorter = (left, right - 1) if right else (left - 1, right)
            if shorter not in level:
                continue
            at, number, words = level[shorter]
            if left and right:  # the phrase without its first word must be a candidate too
                if (left - 1, right) not in level:
                    continue
                both = np.isin(at, level[left - 1, right][0], assume_unique=True)
                at, number, words = at[both], number[both], words[:, both]
            new = rows[right if right else side + left][at]
            has = new != -1
            at, number, words, new = at[has], number[has], words[:, has], new[has]
            if not len(at):
                continue
            local = np.unique(new, return_inverse=True)[1] if new.dtype.itemsize > 4 else new
            key, first, inverse = np.unique(number.astype(np.int64) << 32 | local, return_index=True, return_inverse=True)
            a = np.bincount(inverse, n[at], len(key)) if n[at].sum() < 2**52 else _whole_sums(inverse, n[at], len(key))
            a = a.astype(np.int64)
            words = np.concatenate([words, new[None]]) if right else np.concatenate([new[None], words])
            fine = a >= least[at[first]]
            if fine.any():
                yield words[:, first[fine]], a[fine], at[first[fine]]
                kept = fine[inverse]
                grown[left, right] = at[kept], inverse[kept], words[:, kept]
        level = grown


def _whole_sums(at: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, at, n)
    return out


PHRASE = [f"w{i + 1}" for i in range(LONGEST)]
KEY = ["size", *PHRASE]


def _mined(routed: DataFrame, ranks, split: int, least: int) -> DataFrame:
    """(size, w1 to w4, a, whole): the candidates of each cell; not whole: a part of a split pivot's count."""
    names = [*KEY, "a", "whole"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cell, held = ranks.value, None, []

        def solve() -> Iterator[pa.RecordBatch]:
            parts = [unpack(x) for x in held]
            rows, n, _ = merged(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]))
            whole = known.parts(rows[0], split) <= 1
            for words, a, row in mine(rows, n, np.where(whole, least, 1)):
                columns = [pa.array(known.named(w)) for w in words] + [pa.nulls(len(a), pa.int64())] * (LONGEST - len(words))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), len(words), np.int32)), *columns, pa.array(a), pa.array(whole[row])], names)

        for batch in batches:
            for to, packed in zip(batch.column("cell").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if to != cell:
                    if held:
                        yield from solve()
                    cell, held = to, []
                held.append(packed)
        if held:
            yield from solve()

    dealt = routed.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(scan, f"size int, {', '.join(f'{w} long' for w in PHRASE)}, a long, whole boolean")


def _candidates(rows: DataFrame, least: int, listed: int, split: int) -> tuple[DataFrame, DataFrame]:
    """(frequent words and totals by language, candidates)."""
    spark = rows.sparkSession
    counted = _counted(rows).groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
    words = save(counted.filter((F.col("n") >= least) | F.col("key").isNull()), "op12-words")
    frequent = words.filter("key is not null").select("key", "n")
    many = frequent.count()
    top = frequent if many <= listed else frequent.orderBy(F.desc("n"), "key").limit(listed)
    table = top.toArrow()
    known = Ranks(table["key"].to_numpy().view(np.uint64), table["n"].to_numpy(), many <= listed)
    ranks = spark.sparkContext.broadcast(known)
    total = words.filter("key is null").agg(F.sum("n")).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(4 * partitions, total // CELL + 1)
    found = save(_mined(_routed(rows, ranks, cells, split), ranks, split, least), "op12-mined")
    parts = found.filter("not whole").groupBy(*KEY).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    return words, save(found.filter("whole").drop("whole").unionByName(parts), "op12-candidates", [found])



def _with(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined with ``other`` on the phrase; nulls stand for no word."""
    right = other.withColumnsRenamed({c: f"o_{c}" for c in KEY})
    held = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    same = [F.col(c) == F.col(f"o_{c}") for c in KEY[:3]] + [held(c) == held(f"o_{c}") for c in KEY[3:]]
    return df.join(right, same, how).drop(*(f"o_{c}" for c in KEY))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside: int = 80, listed: int = LISTED, split: int = SPLIT, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` best-scored phrases.

    A candidate of which ``inside`` percent and more lie in one longer candidate is left out.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        return save(_ranked(rows, least, top, inside, listed, split), "op12-ranked", keep=True)


def _ranked(rows: DataFrame, least: int, top: int, inside: int, listed: int, split: int) -> DataFrame:
    words, found = _candidates(rows, least, listed, split)
    totals = words.filter("key is null").select(F.col("lang"), F.col("n").alias("total"))
    names = words.filter("key is not null").select("key", "lang", "word", "n")

    # the parts of two words and more of each longer candidate, and how often they occur
    spots = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LONGEST - 2)), lambda i: F.transform(F.sequence(F.lit(2), F.lit(LONGEST - 1)), lambda k: F.struct(i.alias("at"), k.alias("k"))))),
        lambda s: (s["at"] + s["k"] <= F.col("size")) & (s["k"] < F.col("size")),
    )
    held = F.array(*PHRASE)
    longer = found.filter("size > 2").select(*(F.col(c).alias(f"p_{c}") for c in [*KEY, "a"]), held.alias("held"), F.explode(spots).alias("spot"))
    parts = longer.select(
        *(f"p_{c}" for c in [*KEY, "a"]),
        F.col("spot.at").alias("at"),
        F.col("spot.k").alias("size"),
        *(F.when(F.lit(i) < F.col("spot.k"), F.element_at("held", F.col("spot.at") + F.lit(i + 1))).alias(w) for i, w in enumerate(PHRASE)),
    )
    counts = found.select(*KEY, F.col("a").alias("f"))
    looked = _with(parts, counts).groupBy(*(f"p_{c}" for c in KEY)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at") * F.lit(LONGEST) + F.col("size"), F.col("f")))).alias("parts"))
    looked = looked.withColumnsRenamed({f"p_{c}": c for c in KEY})
    around = parts.groupBy(*KEY).agg(F.max("p_a").alias("most"))

    wide = "decimal(38,0)"
    kept = _with(found, around, "left")
    kept = kept.filter(F.col("most").isNull() | (F.col("most").cast(wide) * 100 < F.col("a").cast(wide) * inside)).drop("most")
    kept = _with(kept, looked, "left")

    # words and their counts
    each = kept.select(*KEY, "a", "parts", F.posexplode(F.filter(held, lambda w: w.isNotNull())).alias("at", "key"))
    spelled = each.join(names, "key").groupBy(*KEY).agg(
        F.first("a").alias("a"), F.first("parts").alias("parts"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word", "n"))).alias("words")
    )

    def count(at: Column, k: Column) -> Column:
        return F.when(k == 1, F.get("words", at)["n"]).otherwise(F.try_element_at("parts", at * F.lit(LONGEST) + k))

    def cut(k: Column) -> Column:
        first, rest = count(F.lit(0), k), count(k, F.col("size") - k)
        score = F.call_function("div", (F.col("a").cast("decimal(20,0)") * F.lit(2_000_000)).cast(wide), (first.cast("decimal(20,0)") + rest).cast(wide))
        return F.struct(score.alias("score"), k.alias("k"), first.alias("l"), rest.alias("r"))

    scored = spelled.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    scored = scored.select("lang", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*best))
    scored = scored.withColumn("first", first).filter(F.col("first") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

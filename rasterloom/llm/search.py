"""Ranked lexical search by windowed bucket scoring.

1. *Index.*  One scan of the documents makes, for windows of ``WINDOW`` consecutive ids,
   the postings (document, term, occurrences) of the terms that any item of the block asks
   for, and the documents' lengths; tasks also count documents, terms and, by term, the
   documents that hold it.  Postings are packed and saved.
2. *Scoring.*  Windows are dealt over tasks; a window whose ids repeat so often that it
   holds over ``SPLIT`` times its width goes to several.  A task takes up to ``WINDOW``
   documents at a time.  For one item after another it traverses the postings of its terms,
   adds weights into an array of ``WINDOW`` sums (64 KB), ors the terms' bitsets of
   occupied places, and harvests the sums of occupied places into the item's heap of k.
3. *Merge.*  Each task's heaps (k rows an item) meet in one ranking by item.

Items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text (a longer item alone);
more items take more blocks, one after the other, never a larger broadcast.

Terms are runs of digits, letters A-Z, taken as a-z, and all characters beyond ASCII.  A
term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))), its part of a score
weight * ((10^9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L.

Defined cases: null and empty texts have no terms: such documents aren't found and such
items find nothing; documents and items with a null id take no part; a repeated document
is found as often as it is there; of items with equal id and text one is ranked, an id
with several texts is ranked for each; equal scores rank by ascending id; other columns
are ignored.  Two terms count as one if their 64-bit hashes agree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import blocks, save
from rasterloom.llm.words import Letters, chunks, whole

LETTERS = Letters.between(bytes(x for x in range(128) if not chr(x).isalnum()))
#: Ids and documents of one window; windows of more documents than so many times that are dealt over tasks.
WINDOW, SPLIT = 1 << 13, 4
#: Bytes of the texts of one block of items; postings that a task gathers before it packs them.
BLOCK_BYTES, GATHERED = 4_000_000, 2_000_000


class Terms:
    """The terms that a block of items asks for."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & np.uint64(0xFFFFF)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are terms, which terms)."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64(0xFFFFF)])
        if not len(self.hashes):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        known = self.hashes[term] == hashes[at]
        return at[known], term[known]


def pack(ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> bytes:
    """Documents (id, terms) and their postings (number of the document, term, occurrences)."""
    sizes = np.array([len(ids), len(doc)], np.int64)
    held = [sizes, ids.astype(np.int64), n.astype(np.int64), tf.astype(np.int64), doc.astype(np.int32), term.astype(np.int32)]
    return zstandard.ZstdCompressor(1).compress(b"".join(x.tobytes() for x in held))


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    docs, postings = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for many, kind in ((docs, np.int64), (docs, np.int64), (postings, np.int64), (postings, np.int32), (postings, np.int32)):
        out.append(np.frombuffer(raw, kind, many, at))
        at += many * np.dtype(kind).itemsize
    ids, n, tf, doc, term = out
    return [ids, n, doc, term, tf]


INDEX = "window long, docs long, packed binary, term int, df long, terms long"


def _index(docs: DataFrame, asked) -> DataFrame:
    """Packed postings by window; each task's (term, df), and its (docs, terms) with neither."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def rows(**columns: list) -> pa.RecordBatch:
        many = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(many, k) for c, k in zip(names, kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value
        df, totals = np.zeros(len(terms.hashes), np.int64), [0, 0]
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            many = np.cumsum([0, *(len(h[0]) for h in held)])
            ids, n, doc, term, tf = (np.concatenate(x) for x in zip(*((i, k, d + many[j], t, f) for j, (i, k, d, t, f) in enumerate(held)), strict=True))
            window = ids // WINDOW
            order = np.lexsort((ids, window))
            at = np.empty(len(ids), np.int64)
            at[order] = np.arange(len(ids))
            ids, n, window, doc = ids[order], n[order], window[order], at[doc]
            posting = np.argsort(doc, kind="stable")
            doc, term, tf = doc[posting], term[posting], tf[posting]
            new = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
            starts = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip(new, [*new[1:], len(ids)], strict=True)])
            ends = np.append(starts[1:], len(ids))
            cut = np.searchsorted(doc, np.append(starts, len(ids)))
            blobs = [pack(ids[a:b], n[a:b], doc[c:d] - a, term[c:d], tf[c:d]) for a, b, c, d in zip(starts.tolist(), ends.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            for a in range(0, len(blobs), 1000):
                yield rows(window=window[starts[a : a + 1000]], docs=(ends - starts)[a : a + 1000], packed=blobs[a : a + 1000])

        for batch in batches:
            n, keys, many = np.zeros(len(batch), np.int64), [], []
            for some in chunks(batch.column("text"), LETTERS):
                n += np.bincount(some.text, minlength=len(batch))
                at, term = terms.find(some.hash)
                key, count = np.unique(some.text[at] * len(terms.hashes) + term, return_counts=True)
                keys.append(key)
                many.append(count)
            key, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
            tf = np.zeros(len(key), np.int64)
            np.add.at(tf, inverse, np.concatenate([np.zeros(0, np.int64), *many]))
            doc, term = np.divmod(key, max(1, len(terms.hashes)))
            df += np.bincount(term, minlength=len(df))
            totals[0] += int(np.count_nonzero(n))
            totals[1] += int(n.sum())
            found = np.flatnonzero(np.bincount(doc, minlength=len(batch)))
            held.append((batch.column("doc").to_numpy()[found], n[found], np.searchsorted(found, doc), term, tf))
            size += len(key)
            if size >= GATHERED:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()
        used = np.flatnonzero(df)
        yield rows(term=used, df=df[used])
        yield rows(docs=totals[:1], terms=totals[1:])

    return docs.mapInArrow(scan, INDEX)


class Scorer:
    """Scores windows for a block of items and keeps each item's k best."""

    def __init__(self, items: list[np.ndarray], df: np.ndarray, docs: int, terms: int, k: int):
        self.docs, self.terms, self.k = docs, terms, k
        self.weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()]
        self.items = [[(int(t), int(m) * self.weights[t]) for t, m in zip(*np.unique(x, return_counts=True), strict=True) if self.weights[t] > 0] for x in items]
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]

    def add(self, parts: list[list[np.ndarray]]) -> None:
        """Score the documents of ``parts``, at most a window's number."""
        first = np.cumsum([0, *(len(p[0]) for p in parts)])
        ids, n = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        doc = np.concatenate([p[2].astype(np.int64) + a for p, a in zip(parts, first, strict=False)])
        term, tf = (np.concatenate([p[c] for p in parts]) for c in (3, 4))
        m = 25 + (75 * n * self.docs) // self.terms
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(term, kind="stable")
        doc, gain = doc[order], gain[order]
        begin = np.searchsorted(term[order], np.arange(len(self.weights) + 1)).tolist()
        sums, bits = np.zeros(len(ids), np.int64), {}
        for heap, item in zip(self.heaps, self.items, strict=True):
            occupied = np.zeros((len(ids) + 7) // 8, np.uint8)
            for t, weight in item:
                a, b = begin[t], begin[t + 1]
                if a == b:
                    continue
                sums[doc[a:b]] += weight * gain[a:b]  # a term has one posting a document
                if t not in bits:
                    held = np.zeros(len(ids), bool)
                    held[doc[a:b]] = True
                    bits[t] = np.packbits(held)
                occupied |= bits[t]
            self._harvest(heap, ids, sums, np.flatnonzero(np.unpackbits(occupied, count=len(ids))))

    def _harvest(self, heap: list[tuple[int, int]], ids: np.ndarray, sums: np.ndarray, places: np.ndarray) -> None:
        score = sums[places]
        sums[places] = 0
        good = score >= heap[0][0] if len(heap) == self.k else score > 0
        places, score = places[good], score[good]
        if len(score) > self.k:
            good = score >= -np.partition(-score, self.k - 1)[self.k - 1]
            places, score = places[good], score[good]
        best = np.lexsort((ids[places], -score))[: self.k]
        for entry in zip(score[best].tolist(), (-ids[places[best]]).tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)


def _scored(index: DataFrame, scorer) -> DataFrame:
    """(q, doc_id, score): each task's k best of each item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, held, size = Scorer(*scorer.value), [], 0
        for batch in batches:
            for many, packed in zip(batch.column("docs").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if held and size + many > WINDOW:
                    job.add(held)
                    held, size = [], 0
                held.append(unpack(packed))
                size += many
        if held:
            job.add(held)
        found = [(q, -low, score) for q, heap in enumerate(job.heaps) for score, low in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["q", "doc_id", "score"])

    hot = index.groupBy("window").agg(F.sum("docs").alias("docs")).filter(F.col("docs") > SPLIT * WINDOW)
    hot = hot.select("window", F.ceil(F.col("docs") / F.lit(SPLIT * WINDOW)).alias("parts"))  # at most one for SPLIT * WINDOW documents
    rows = index.select("window", "docs", "packed").join(F.broadcast(hot), "window", "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("packed"), F.coalesce("parts", F.lit(1).cast("long"))))
    return rows.repartition("window", "part").sortWithinPartitions("window").select("docs", "packed").mapInArrow(scan, "q long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null").distinct()
    made = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(asked.orderBy("item_id", "text"), "text", block_bytes):
        hashes, border = whole(pa.array([r.text for r in block], pa.string()), LETTERS)
        terms = Terms(hashes)
        index = save(_index(rows, spark.sparkContext.broadcast(terms)), "op13-index")
        df = np.zeros(len(terms.hashes), np.int64)
        for r in index.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        n, total = index.filter("window is null and term is null").agg(F.sum("docs"), F.sum("terms")).first()
        asks = [np.searchsorted(terms.hashes, hashes[a:b]) for a, b in zip(border[:-1], border[1:], strict=True)]
        found = _scored(index.filter("window is not null"), spark.sparkContext.broadcast((asks, df, n or 0, total or 1, k)))
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
        named = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(block)], "q long, item_id long")
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(named), "q")
        made = made.unionByName(save(best.select("item_id", "rank", "doc_id", "score"), "op13-found", [index]))
    return made

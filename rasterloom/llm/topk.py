"""Exact top-k inner-product search by distributed histogram selection.

For a block of queries every candidate is scored, in chunks, by one matrix
product.  Tasks emit per query a histogram of scores over the open range; the sums
tell which bin holds the k-th best score, which becomes the next open range, until
the bin is one integer wide.  A last scan keeps what reaches the k-th score; each
task keeps at most its own k best by (score, smaller id), which loses nothing, and
a window ranks the rest.  What moves is bins and k rows per query and task, however
many candidates tie.

Query vectors go to the tasks in blocks of at most ``block`` rows (a proven bound);
more queries mean more rounds, never a larger broadcast.

Defined cases: vectors that are null, or hold null or non-finite components, and
rows with a null id take no part; vectors of another length than the query's don't
meet it; a query meets every row but those with its own id; repeated rows are
repeated candidates; fewer than k candidates give as many ranks; scores are exact, and
one that doesn't fit in 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import save

BINS = 64
#: Candidates in one matrix product.
CHUNK = 2048


def _usable(df: DataFrame, vec: str, embedding: str) -> DataFrame:
    x = F.col(embedding)
    fine = x.isNotNull() & F.col(vec).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df.select(F.col(vec).cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(fine)


def quantize(rows: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * rows)


def _vectors(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, quantised vectors) of the batch, by vector length."""
    lists = batch.column("embedding")
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield ids[at], quantize(flat[starts[at][:, None] + np.arange(size)], scale)


def _product(queries: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Integer inner products (of ``own`` pairs anything): by float64 where those are exact, else by int64 or Python's integers."""
    if not rows.shape[1]:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1]
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if most < 2**63:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    whole = [[[int(x) for x in row] for row in side.tolist()] for side in (queries, rows)]
    scores = np.array([[sum(map(int.__mul__, a, b)) for b in whole[1]] for a in whole[0]], object).reshape(len(queries), len(rows))
    scores[own] = 0
    if scores.size and max(abs(scores.min()), abs(scores.max())) >= 2**63:
        raise OverflowError("a score doesn't fit in 64 bits")
    return scores.astype(np.int64)


class Block:
    """Queries of one length and their open ranges, as the tasks see them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: int):
        self.ids, self.vectors, self.scale = ids, vectors, scale

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, scores by query, own) for chunk after chunk."""
        for batch in batches:
            for ids, rows in _vectors(batch, self.scale):
                if rows.shape[1] == self.vectors.shape[1]:
                    for i in range(0, len(ids), CHUNK):
                        part = ids[i : i + CHUNK]
                        own = self.ids[:, None] == part
                        yield part, _product(self.vectors, rows[i : i + CHUNK], own), own


def _ranges(rows: DataFrame, block) -> DataFrame:
    def scan(batches):
        b = block.value
        low, high, n = np.full(len(b.ids), np.iinfo(np.int64).max), np.full(len(b.ids), np.iinfo(np.int64).min), np.zeros(len(b.ids), np.int64)
        for _, s, own in b.scores(batches):
            low = np.minimum(low, np.where(own, low[:, None], s).min(axis=1))
            high = np.maximum(high, np.where(own, high[:, None], s).max(axis=1))
            n += (~own).sum(axis=1)
        q = np.flatnonzero(n)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q, low[q], high[q], n[q])], ["q", "low", "high", "n"])

    made = rows.mapInArrow(scan, "q long, low long, high long, n long")
    return made.groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _histogram(rows: DataFrame, block, low: np.ndarray, high: np.ndarray, width: np.ndarray) -> DataFrame:
    """(q, bin, n) of the scores inside each query's open range."""

    def scan(batches):
        b = block.value
        counts = np.zeros((len(b.ids), BINS), np.int64)
        base = np.arange(len(b.ids))[:, None] * BINS
        for _, s, own in b.scores(batches):
            at = ((s - low[:, None]).view(np.uint64) // width[:, None]).astype(np.int64)  # a range may take all 64 bits
            inside = (s >= low[:, None]) & (s <= high[:, None]) & ~own
            counts += np.bincount((base + at)[inside], minlength=counts.size).reshape(counts.shape)
        q, bins = np.nonzero(counts)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (q, bins, counts[q, bins])], ["q", "bin", "n"])

    made = rows.mapInArrow(scan, "q long, bin long, n long")
    return made.groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _best(rows: DataFrame, block, floor: np.ndarray, k: int) -> DataFrame:
    def scan(batches):
        b = block.value
        q, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        for part, s, own in b.scores(batches):
            at, c = np.nonzero((s >= floor[:, None]) & ~own)
            q, ids, scores = np.concatenate([q, at]), np.concatenate([ids, part[c]]), np.concatenate([scores, s[at, c]])
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            first = np.searchsorted(q, q, "left")
            kept = np.arange(len(q)) - first < k
            q, ids, scores = q[kept], ids[kept], scores[kept]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (b.ids[q], q, ids, scores)], ["query_id", "q", "vec_id", "score"])

    return rows.mapInArrow(scan, "query_id long, q long, vec_id long, score long")


def _select(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, scale: int, k: int) -> DataFrame:
    """The k best of each query of a block."""
    block = rows.sparkSession.sparkContext.broadcast(Block(ids, vectors, scale))
    n = len(ids)
    low, high, need = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in _ranges(rows, block).collect():
        low[r.q], high[r.q], need[r.q] = r.low, r.high, min(k, r.n)
    while True:
        width = (high - low).view(np.uint64) // np.uint64(BINS) + np.uint64(1)
        open_ = (need > 0) & (high > low)
        if not open_.any():
            break
        above = Window.partitionBy("q").orderBy(F.desc("bin"))
        needs = F.broadcast(rows.sparkSession.createDataFrame([(int(q), int(need[q])) for q in np.flatnonzero(open_)], "q long, need long"))
        sums = _histogram(rows, block, low, high, width).join(needs, "q").withColumn("upto", F.sum("n").over(above))
        for r in sums.filter("upto >= need and upto - n < need").select("q", "bin", F.expr("need - (upto - n)").alias("left")).collect():
            first = int(low[r.q]) + r.bin * int(width[r.q])
            low[r.q], high[r.q], need[r.q] = first, min(int(high[r.q]), first + int(width[r.q]) - 1), r.left
    found = _best(rows, block, low, k)
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, block: int = 2048, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id ``every`` divides."""
    rows = _usable(df, vec, embedding)
    asked = save(rows.filter(F.col("vec_id") % every == 0).distinct().withColumn("size", F.size("embedding")), "op8-queries")
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ordered = asked.orderBy("size", "vec_id", "embedding").toLocalIterator()
    for size, same in groupby(ordered, key=lambda r: r["size"]):
        while mine := list(islice(same, block)):
            vectors = quantize(np.array([r.embedding for r in mine], float).reshape(len(mine), size), scale)
            out = out.unionByName(_select(rows, np.array([r.vec_id for r in mine], np.int64), vectors, scale, k))
    return out

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import save


#: Edges (16 bytes each) up to which one task solves the graph; more take the stars.
ONE_TASK = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for k in (0, 1):
            ends[k].append(batch.column(k).to_numpy())
    nodes, comp = union_find(*map(np.concatenate, ends))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], ["node", "comp"])


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``edges`` (a, b).

    Every step is a partial aggregate and a join on the node; edges stay in the
    shared folder between steps, and the steps needed grow with the logarithm of
    the number of nodes.  Graphs of at most ``ONE_TASK`` edges, a checked bound, go
    to one task instead, which saves the steps' overhead and gives the same rows.
    Null ends and loops are ignored.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = save(now, "edges")
    seen = _digest(now)
    if seen[0] <= ONE_TASK:
        return save(now.repartition(1).mapInArrow(_solved, "node long, comp long"), "comps")
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        now = save(small.distinct(), "edges")
        before, seen = seen, _digest(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())

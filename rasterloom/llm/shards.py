"""Sharding by a two-pass external shuffle.

1. *Scatter.*  A seeded hash of the whole row deals rows uniformly into buckets of about
   ``BUCKET_BYTES``, as many as the sum of sizes asks for.  Equal texts under different
   ids fall apart like any other rows.  Rows equal in every column share a hash: where such
   copies fill half a bucket, each of them is salted (there are at most two such rows for
   each bucket, which bounds the broadcast list).
2. *Shuffle.*  A task takes one bucket after the other, in order of the hash, permutes its
   records by Fisher-Yates with a generator seeded for the bucket, and writes them.

Running sums of the buckets' counts give each record its place in the whole order.  The
law is ``rows``: shard s takes the places from (s * N) div S on, so that counts are at
most one apart, and the slot is the place within the shard.  The order depends on seed,
rows and bucket size, not on how the input is split (but for salted copies, which are
the same in all columns).  A lost task repeats the same permutation.

Defined cases: a null text has no bytes and is a record like any other; a null id too;
repeated rows are records each; an empty table gives no rows; a record larger than a
bucket is held alone with the bucket it falls into; other columns travel with the record
(those of map type don't count for the hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterloom.llm.common import BATCH_ROWS, fresh, save

BUCKET_BYTES = 32_000_000
#: Bytes that a record takes besides its text.
RECORD = 8
#: Buckets whose counts are summed in one task, and buckets whose offsets are broadcast (16 bytes each).
TOGETHER, SENT = 4096, 2_000_000


def size_of(text: str | Column) -> Column:
    """Bytes of a record: its text's in UTF-8, and 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(RECORD)).cast("long")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0 to n - 1."""
    order = list(range(n))
    picks = rng.integers(0, np.arange(n, 1, -1)).tolist()
    for last, pick in zip(range(n - 1, 0, -1), picks, strict=True):
        order[last], order[pick] = order[pick], order[last]
    return np.array(order, np.int64)


def _scattered(docs: DataFrame, seed: int, bucket_bytes: int, text: str, mark: str, bucket: str) -> tuple[DataFrame, int]:
    """(rows with their hash and bucket, number of buckets)."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumn(mark, F.xxhash64(F.lit(seed), *hashed))
    size = fresh("__size", rows)
    copies = rows.select(mark, size_of(text).alias(size)).groupBy(mark, size).agg(F.count("*").alias("n"))
    copies = save(copies, "op11-marks")
    total = copies.agg(F.sum(F.col(size) * F.col("n"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    heavy = save(copies.filter((F.col("n") > 1) & (2 * F.col(size) * F.col("n") > bucket_bytes)).select(mark).distinct(), "op11-heavy", [copies])
    salt = F.lit(0).cast("long")
    if not heavy.isEmpty():
        often = fresh("__often", rows)
        heavy = heavy.withColumn(often, F.lit(True))
        rows = rows.join(F.broadcast(heavy) if buckets <= SENT else heavy, mark, "left")
        salt = F.when(F.col(often), F.monotonically_increasing_id()).otherwise(salt)
        rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), mark, salt), F.lit(buckets))).drop(often)
    else:
        rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), mark, salt), F.lit(buckets)))
    return rows.select(*docs.columns, mark, bucket), buckets


def _shuffled(rows: DataFrame, seed: int, mark: str, bucket: str, place: str) -> DataFrame:
    """Each bucket's rows in their new order, with ``place`` in the bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = None, []

        def solve() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(len(whole), np.random.default_rng([seed, number]))
            for first in range(0, len(whole), BATCH_ROWS):
                part = order[first : first + BATCH_ROWS]
                made = whole.take(pa.array(part)).append_column(place, pa.array(np.arange(first, first + len(part))))
                yield from made.combine_chunks().to_batches()

        for batch in batches:
            at = batch.column(batch.schema.get_field_index(bucket)).to_numpy()
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if number != at[a]:
                    if held:
                        yield from solve()
                    number, held = int(at[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve()

    dealt = rows.repartition(bucket).sortWithinPartitions(bucket, mark).drop(mark)
    return dealt.mapInArrow(scan, StructType([*dealt.schema.fields, StructField(place, LongType())]))


def _offsets(saved: DataFrame, bucket: str, offset: str) -> DataFrame:
    """The first place of each bucket in the whole order."""
    counts = saved.groupBy(bucket).agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col(bucket) / F.lit(TOGETHER)))
    counts = save(counts, "op11-counts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    within = counts.withColumn("within", before(Window.partitionBy("part").orderBy(bucket)))
    return within.join(parts, "part").select(bucket, (F.col("base") + F.col("within")).alias(offset))


def shard(docs: DataFrame, shards: int = 24, seed: int = 20_250_601, bucket_bytes: int = BUCKET_BYTES, text: str = "text", out: str = "shard", slot: str = "slot") -> DataFrame:
    """``docs`` in shuffled order, with the shard and the slot in it."""
    mark, bucket, place = (fresh(x, docs) for x in ("__mark", "__bucket", "__place"))
    rows, buckets = _scattered(docs, seed, bucket_bytes, text, mark, bucket)
    saved = save(_shuffled(rows, seed, mark, bucket, place), "op11-buckets")
    n = max(1, saved.count())
    offset = fresh("__offset", saved)
    offsets = save(_offsets(saved, bucket, offset), "op11-offsets")
    placed = saved.join(F.broadcast(offsets) if buckets <= SENT else offsets, bucket).withColumn(place, F.col(offset) + F.col(place))
    number = F.expr(f"((`{place}` + 1) * {shards} - 1) div {n}")
    made = placed.withColumn(out, number.cast("int"))
    return made.withColumn(slot, F.col(place) - F.expr(f"(`{out}` * {n}L) div {shards}")).drop(mark, bucket, place, offset)


def write(sharded: DataFrame, path: str, out: str = "shard", slot: str = "slot") -> None:
    """A folder for each shard; its files hold runs of slots in order.  Nothing is shuffled again."""
    sharded.sortWithinPartitions(out, slot).write.partitionBy(out).parquet(path)



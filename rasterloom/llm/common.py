"""Helpers shared by the text operators: session settings, checkpoints, hashing."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rasterloom import storage
from rasterloom.storage import drop, scratch  # noqa: F401

#: Texts and their numbers are large on disk too.
save = partial(storage.save, packed=True)

ROOT = str(Path(__file__).resolve().parents[2])

#: Documents in one Arrow batch.  Bounds what a Python worker holds at once.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and keep Arrow batches small."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def blocks(rows: DataFrame, text: str, most: int) -> Iterator[list[Row]]:
    """The rows in their order, so many at a time as have ``most`` bytes of text; a longer text alone."""
    held, size = [], 0
    for row in rows.toLocalIterator():
        more = len((row[text] or "").encode())
        if held and size + more > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += more
    if held:
        yield held


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until none of the frames has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, made: Column, fields: dict[str, str]) -> DataFrame:
    """``df`` plus fields of a struct that is made once a row, under the names wanted."""
    held = fresh("__made", df)
    out = df.withColumn(held, made).withColumns({name: F.col(f"{held}.{field}") for field, name in fields.items()})
    return out.drop(held)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

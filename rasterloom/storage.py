"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a local one in local mode only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (where or "file:///tmp/checkpoints").rstrip("/")


#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Open(threading.local):
    """Paths of the tables saved inside each open ``scratch`` of a thread."""

    def __init__(self):
        self.levels: list[list[str]] = []


_open = _Open()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables saved inside when it ends, also by an error, but for those saved with ``keep``."""
    _open.levels.append([])
    try:
        yield
    finally:
        for folder in _open.levels.pop():
            _delete(spark, folder)


def save(df: DataFrame, label: str, spent: Iterable[DataFrame] = (), keep: bool = False, packed: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and read it back.

    The write's shuffle files go as soon as it ends, and so do ``spent``: tables from
    here that nothing reads any more.  ``keep``: the innermost ``scratch`` leaves it.

    Spark takes a table's bytes on disk for its size in memory.  Pixels shrink to a
    fraction when ``packed`` (by dictionary and zstd), so that millions of them look small
    enough to broadcast; written plainly they take on disk about what they are.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    levels = _open.levels[:-1] if keep else _open.levels
    if levels:
        levels[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        how = {"compression": "zstd"} if packed else {"compression": "none", "parquet.enable.dictionary": "false"}
        df.write.options(**how).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    drop(*spent)
    return spark.read.schema(df.schema).parquet(path)


def drop(*saved: DataFrame) -> None:
    """Delete tables made by ``save``."""
    for df in saved:
        spark = df.sparkSession
        within = shared_dir(spark).split("://")[-1].split(":")[-1]
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if within in folder:
                _delete(spark, folder)

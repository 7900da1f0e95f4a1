"""Plans in a log of versions: commits are put if absent, readers see whole commits only.

A commit is a folder ``v=<number>`` with the plans that it changes.  It is written aside
and renamed into place, which fails where that version exists already: the loser deletes
what it wrote, reads the plans anew and applies its edit to them again, so that no edit is
lost.  A write that fails leaves the former version in force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLANS = "session_id string, plan string"


class Conflict(RuntimeError):
    """Other writers won every try."""


def _java(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _java(spark, path)
    files.delete(where, True)


def _put(spark: SparkSession, staged: str, path: str) -> bool:
    """Renames ``staged`` to ``path`` unless that exists."""
    source, files = _java(spark, staged)
    target, _ = _java(spark, path)
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(source, target, options)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def last_version(spark: SparkSession, root: str) -> int:
    """The number of the last commit, 0 if there is none."""
    where, files = _java(spark, root)
    if not files.util().exists(where):
        return 0
    names = [x.getPath().getName() for x in files.util().listStatus(where)]
    return max((int(n[2:]) for n in names if n.startswith("v=")), default=0)


def latest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(session_id, plan, version): each session's last plan, as of a version if one is given."""
    version = last_version(spark, root) if version is None else version
    empty = spark.createDataFrame([], PLANS).withColumn("version", F.lit(0).cast("long"))
    if not version:
        return empty
    try:
        rows = spark.read.schema(f"{PLANS}, v int").option("basePath", root).parquet(f"{root}/v=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
    last = Window.partitionBy("session_id").orderBy(F.desc("v"))
    rows = rows.filter(F.col("v") <= version).withColumn("k", F.row_number().over(last)).filter("k = 1")
    return rows.select("session_id", "plan", F.col("v").cast("long").alias("version")).filter(F.col("plan").isNotNull())


def commit(spark: SparkSession, root: str, edit: Callable[[DataFrame], DataFrame], tries: int = 20) -> int:
    """Writes the plans that ``edit`` makes of the latest ones and returns the version.

    ``edit`` takes (session_id, plan, version) and returns (session_id, plan), a null plan
    to remove one; it may be called again after another writer's commit.
    """
    for _ in range(tries):
        version = last_version(spark, root)
        staged = f"{root}/.staged-{uuid.uuid4().hex}"
        try:
            edit(latest(spark, root, version)).select(F.col("session_id").cast("string"), F.col("plan").cast("string")).write.parquet(staged)
            if _put(spark, staged, f"{root}/v={version + 1:08d}"):
                return version + 1
        except BaseException:
            _delete(spark, staged)
            raise
        _delete(spark, staged)
    raise Conflict(f"{tries} commits were overtaken")

"""Corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of ``documents``; the last returns token ids.
Decisions: the classifier drops documents scored under 0.3; line dedup rewrites
``text`` (and ``n_chars``) and drops documents of which no line is left; of each
near-duplicate component the smallest id stays; documents that leak a benchmark
item go; BPE adds ids and whether they decode to the text again.

Null texts are scored and encoded as empty ones; empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontam, jaccard, lines, quality
from rasterloom.llm.common import save
from rasterloom.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents scored lower are rejected.
LEAST_QUALITY = 0.3


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(COLUMNS), forest, out="__score")
    return scored.filter(F.col("__score") >= LEAST_QUALITY).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = lines.dedup_lines(docs.select(COLUMNS), removed="__removed")
    emptied = (F.col("__removed") > 0) & (F.btrim("text", F.lit(" \t\r\n")) == "")
    made = made.filter(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return made.withColumn("n_chars", changed).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    made = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", filter_quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Trees, edit distance and merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

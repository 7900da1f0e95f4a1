"""Cross-site line deduplication by distinct-site spread, all in Catalyst.

A line that occurs at ``min_sites`` distinct sites or more is boilerplate.  Each
line hash gets a HyperLogLog sketch of its sites; sketches merge map-side and then
across tasks, so a line that a third of all documents hold costs one small row per
task.  Lines whose estimate is within a factor of two of the threshold get exact
distinct counts, the others keep the sketch's verdict (the band is over seven
standard errors wide).  Only occurrences of lines at or above the band are ever
written out.

Boilerplate is removed everywhere but at its first place (smallest id, then
smallest position), so no passage vanishes from the corpus.

Defined cases: lines compare without blanks at their ends; blank lines are never
boilerplate; a null text counts as empty; a null site is one site of its own;
documents with a null id are kept whole; repeated rows share one decision; all
other columns pass through, but for those of the output's names, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import fresh, save

#: What is stripped from a line's ends, and the sketch size (log2).
BLANKS, LOG_K = " \t\r", 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(df: DataFrame, doc: str, site: str, text: str) -> DataFrame:
    """(doc, text_key, pos, h1, h2, site): a row for each line that isn't blank."""
    rows = df.select(
        F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("text_key"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit(""))).alias("site"), F.posexplode(_lines(F.col(text))).alias("pos", "line")
    ).withColumn("line", F.btrim("line", F.lit(BLANKS)))
    return rows.filter("line <> ''").select("doc", "text_key", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"))


def spread_lines(df: DataFrame, min_sites: int = 10, doc: str = "doc_id", site: str = "source", text: str = "text") -> DataFrame:
    """(doc, text_key, pos) of every boilerplate line that is to go."""
    lines = _occurrences(df, doc, site, text)
    sketches = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("about"))
    wide = save(sketches.filter(F.col("about") >= min_sites / 2), "op3-wide")
    held = save(lines.join(wide, ["h1", "h2"]), "op3-held")
    near = held.filter(F.col("about") < 2 * min_sites).groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = near.groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("h1", "h2")
    sure = wide.filter(F.col("about") >= 2 * min_sites).select("h1", "h2")
    first = held.filter("doc is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc", "pos", "text_key")).alias("first"))
    decided = save(exact.unionByName(sure).join(first, ["h1", "h2"]), "op3-decided", [wide])
    gone = held.join(decided, ["h1", "h2"])
    return gone.filter(F.struct("doc", "pos", "text_key") != F.col("first")).select("doc", "text_key", "pos")


def dedup_lines(df: DataFrame, min_sites: int = 10, doc: str = "doc_id", site: str = "source", text: str = "text", out: str = "text", removed: str | None = None) -> DataFrame:
    """``df`` with ``out`` holding the text without boilerplate lines.

    ``removed`` names an optional column for the number of lines removed.
    """
    gone = spread_lines(df, min_sites, doc, site, text)
    names = {n: fresh(f"__{n}", df) for n in ("doc", "text_key", "pos", "hash")}
    gone = gone.groupBy("doc", "text_key").agg(F.collect_set("pos").alias("pos")).withColumnsRenamed(names)
    keyed = df.withColumn(names["hash"], F.xxhash64(F.col(text)))
    both = keyed.join(gone, (F.col(doc) == F.col(names["doc"])) & (F.col(names["hash"]) == F.col(names["text_key"])), "left")
    pos = F.col(names["pos"])

    def without(lines: Column) -> Column:
        """The lines at the places that stay; each step is linear in their number."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), pos)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    kept = F.transform(F.array(_lines(F.col(text))), without)[0]  # binds the lines, so that they are split once
    made = {out: F.when(pos.isNull(), F.col(text)).otherwise(kept)}
    if removed:
        made[removed] = F.greatest(F.size(pos), F.lit(0)).cast("long")
    return both.withColumns(made).drop(*names.values())

"""Mesh folders as DataFrames: OBJ and MTL text, alignment JSON, folder reports, rasters.

Readers go through Spark's own sources (``text``, ``binaryFile``, ``image``, ``json``,
``parquet``), so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File kinds kept when a folder is staged, folders and files left out.
KINDS = ["obj", "mtl", "jpg", "jpeg", "png", "json"]
SKIPPED = ["keyframes", "depth", "confidence", "cameras", "corrected_cameras", "images", "corrected_images"]
SKIPPED_FILES = [".DS_Store", "thumbnail.jpg", "polycam.mp4", "ceiling_geometry.json", "ceiling_geometry_preview.png", "roomplan.json"]


#: Lines that one window looks at; longer files carry sums and the last material from part to part.
PART = 1 << 16


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lineno, line) of text files, read in splits.

    A split is read in order by one task, so a line's number is the number of lines in the
    file's earlier splits plus its place in its own.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.regexp_replace("value", "\r$", "").alias("line"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("before", F.coalesce(before, F.lit(0))).select("file", "split", "first", "before")
    return rows.join(splits, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("lineno"), "line")


def _parted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("__part", F.floor(F.col("lineno") / F.lit(PART)))


def _tokens() -> Column:
    return F.split(F.trim(F.col("line")), r"\s+")


def _numbered(lines: DataFrame, word: str, by: str = "id") -> DataFrame:
    """Lines that begin with ``word``, numbered by ``id`` from 0 in file order."""
    rows = _parted(lines).withColumn("t", _tokens()).filter(F.element_at("t", 1) == word)
    return _ordered(rows, ["lineno"], by)


def _ordered(rows: DataFrame, order: list[str], by: str) -> DataFrame:
    """Adds the place in the file: the rows of earlier parts plus the place in the part."""
    before = F.sum("n").over(Window.partitionBy("file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy("file", "__part").agg(F.count("*").alias("n")).select("file", "__part", F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("file", "__part").orderBy(*order)) - 1
    return rows.withColumn("__in", within).join(base, ["file", "__part"]).withColumn(by, F.col("__base") + F.col("__in")).drop("__part", "__base", "__in")


def vertices(lines: DataFrame) -> DataFrame:
    """(file, vid, x, y, z) of ``v`` lines in file order."""
    return _numbered(lines, "v").select("file", F.col("id").alias("vid"), *(F.element_at("t", k + 2).cast("double").alias(c) for k, c in enumerate("xyz")))


def uvs(lines: DataFrame) -> DataFrame:
    return _numbered(lines, "vt").select("file", F.col("id").alias("tid"), *(F.element_at("t", k + 2).cast("double").alias(c) for k, c in enumerate("uv")))


def materials(lines: DataFrame) -> DataFrame:
    """(file, mat, name), numbered by first use."""
    used = lines.withColumn("t", _tokens()).filter(F.element_at("t", 1) == "usemtl").withColumn("name", F.element_at("t", 2))
    first = used.groupBy("file", "name").agg(F.min("lineno").alias("at"))
    return first.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).alias("mat"), "name")


def faces(lines: DataFrame) -> DataFrame:
    """(file, fid, lineno, part, v, t, mat): triangles of fans, 0-based, with their material.

    A missing texture index falls back to the vertex's; faces before any ``usemtl``
    have material -1.
    """
    from rasterloom.operators.mesh import fan

    rows = _parted(lines).withColumn("w", _tokens()).filter(F.element_at("w", 1).isin("f", "usemtl"))
    said = F.when(F.element_at("w", 1) == "usemtl", F.element_at("w", 2))
    upto = Window.partitionBy("file", "__part").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("file", "__part").agg(F.max_by(said, F.when(said.isNotNull(), F.col("lineno"))).alias("__end"))
    ends = ends.select("file", "__part", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    rows = rows.withColumn("__said", F.last(said, ignorenulls=True).over(upto)).join(ends, ["file", "__part"]).withColumn("name", F.coalesce("__said", "__carried")).drop("__said", "__carried")
    rows = rows.filter(F.element_at("w", 1) == "f").join(materials(lines), ["file", "name"], "left").withColumn("mat", F.coalesce("mat", F.lit(-1)))

    def corner(word: Column) -> Column:
        part = F.split(word, "/")
        v = F.element_at(part, 1).cast("bigint") - 1
        t = F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("bigint") - 1, v)
        return F.struct(v.alias("v"), t.alias("t"))

    rows = rows.withColumn("polygon", F.transform(F.slice("w", F.lit(2), F.size("w") - 1), corner))
    tri = _ordered(fan(rows, "polygon"), ["lineno", "part"], "fid")
    corners = F.col("v")
    return tri.select("file", "fid", "lineno", "part", F.transform(corners, lambda c: c["v"]).alias("v"), F.transform(corners, lambda c: c["t"]).alias("t"), "mat")


def mtllib(lines: DataFrame) -> DataFrame:
    """(file, mtl): the rest of the first ``mtllib`` line."""
    rows = lines.filter(F.startswith("line", F.lit("mtllib")))
    return rows.groupBy("file").agg(F.min(F.struct("lineno", "line"))["line"].alias("line")).select("file", F.trim(F.substr("line", F.lit(7))).alias("mtl"))


def textures(lines: DataFrame) -> DataFrame:
    """(file, name, texture): the last ``map_Kd`` of each material of an MTL file."""
    order = Window.partitionBy("file").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("t", _tokens()).withColumn("name", F.last(F.when(F.element_at("t", 1) == "newmtl", F.try_element_at("t", F.lit(2))), ignorenulls=True).over(order))
    rows = rows.filter((F.element_at("t", 1) == "map_Kd") & F.col("name").isNotNull())
    rest = F.array_join(F.slice("t", F.lit(2), F.size("t") - 1), " ")
    return rows.groupBy("file", "name").agg(F.max_by(rest, "lineno").alias("texture"))


def alignment(spark: SparkSession, path: str) -> list[float]:
    """The inverse of a column-major 4 x 4 ``alignmentTransform``, row-major, 12 numbers."""
    import numpy as np

    row = spark.read.schema("alignmentTransform array<double>").json(path, multiLine=True).first()
    m = np.array(row.alignmentTransform).reshape(4, 4).T
    return np.linalg.inv(m)[:3].ravel().tolist()


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, length) of a folder's files, those left out of staging removed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return staged(files)


def staged(files: DataFrame) -> DataFrame:
    """Files of the kept kinds outside the skipped folders."""
    parts = F.split("path", "/")
    rows = files.withColumn("name", F.element_at(parts, -1)).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return rows.filter(F.col("kind").isin(KINDS) & ~F.arrays_overlap(above, F.array(*map(F.lit, SKIPPED))) & ~F.col("name").isin(SKIPPED_FILES))


def report(files: DataFrame, lib: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: chosen OBJ and MTL, textures found and missing, warnings, errors, ok.

    ``files`` as by ``folder``; ``lib`` (mtl) and ``wanted`` (texture) as parsed.
    """
    objs = files.filter("kind = 'obj'").agg(F.max_by("path", F.struct("length", "path")).alias("obj"), F.count("*").alias("n_obj"))
    mtls = files.filter("kind = 'mtl'").agg(F.min("path").alias("any_mtl"))
    named = lib.join(files.filter("kind = 'mtl'"), F.element_at(F.split("mtl", "/"), -1) == F.col("name")).agg(F.min("path").alias("own_mtl"))
    info = files.filter("name = 'mesh_info.json'").agg(F.min("path").alias("mesh_info"))
    base = wanted.select("texture", F.element_at(F.split("texture", "/"), -1).alias("name")).distinct()
    seen = base.join(files.select("name", "path"), "name", "left").groupBy("texture").agg(F.min("path").alias("path"))
    tex = seen.agg(F.count("path").alias("textures_found"), F.sort_array(F.collect_list(F.when(F.col("path").isNull(), F.col("texture")))).alias("textures_missing"))
    row = objs.join(mtls).join(named).join(info).join(tex)
    mtl = F.coalesce("own_mtl", "any_mtl")
    warnings = F.array(
        F.when(F.col("n_obj") > 1, F.lit("several OBJ files; the largest is used")),
        F.when(F.col("own_mtl").isNull() & F.col("any_mtl").isNotNull(), F.lit("mtllib not found; the first MTL is used")),
        F.when(F.size("textures_missing") > 0, F.lit("textures are missing")),
        F.when(F.col("mesh_info").isNull(), F.lit("mesh_info.json is missing")),
    )
    errors = F.array(F.when(F.col("obj").isNull(), F.lit("no OBJ file")), F.when(mtl.isNull(), F.lit("no MTL file")))
    row = row.withColumn("mtl", mtl).withColumn("warnings", F.array_compact(warnings)).withColumn("errors", F.array_compact(errors))
    return row.select("obj", "mtl", "mesh_info", "textures_found", "textures_missing", "warnings", "errors", (F.size("errors") == 0).alias("ok"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(file, tu, tv, r, g, b): decoded textures, one row per texel."""
    rows = spark.read.format("image").load(path).select("image.*")
    at = rows.select("origin", "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * F.col("nChannels") + k, F.lit(1))), 16, 10).cast("smallint")
    return at.select(F.col("origin").alias("file"), (F.col("i") % F.col("width")).alias("tu"), F.floor(F.col("i") / F.col("width")).cast("int").alias("tv"), byte(3).alias("r"), byte(2).alias("g"), byte(1).alias("b"))


def write_pixels(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("session_id").parquet(path)


def write_leaderboard(df: DataFrame, path: str) -> None:
    """JSON and CSV of a ranked table, numbers with four decimals in the CSV."""
    df.write.mode("overwrite").json(f"{path}/json")
    said = [F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(said).write.mode("overwrite").option("header", True).csv(f"{path}/csv")

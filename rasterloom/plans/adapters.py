"""Pixel and face tables made from the driver's tables by exact integer arithmetic.

The driver has no scans; these adapters give its ``events`` and ``part`` rows the shape
of rasters and meshes, so that each operator can run over a whole table and be
compared with SQL.  A scan is 100 by 100 pixels, heights are whole millimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, u, v, plane, y_mm): four planes in blocks, jitter under 2 cm, holes."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    rows = rows.selectExpr("cast(event_id div 10000 as bigint) session_id", "cast(event_id % 100 as int) u", "cast((event_id div 100) % 100 as int) v", "event_type", "value")
    rows = rows.withColumn("plane", F.expr("cast((u div 25 + 2 * (v div 25)) % 4 as int)"))
    height = F.expr("case when event_type = 'error' and value > 5 then null else cast(2400 + 150 * plane + (cast(round(value * 100) as bigint) % 20) as int) end")
    return rows.select("session_id", "u", "v", "plane", height.alias("y_mm"))


PIXELS = """
px as (
  select session_id, u, v, plane, case when event_type = 'error' and value > 5 then null else (2400 + 150 * plane + (round(value * 100)::bigint % 20))::int end as y_mm
  from (select *, ((u // 25 + 2 * (v // 25)) % 4)::int as plane from (
    select (event_id // 10000)::bigint as session_id, (event_id % 100)::int as u, ((event_id // 100) % 100)::int as v, event_type, value from events))
)"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel table that segmentation takes: y in metres, room, walls and colours."""
    px = pixels(spark, sf_dir)
    colour = [(60 * F.col("plane") + 10 * k).cast("smallint").alias(c) for k, c in enumerate("rgb")]
    wall = ((F.col("u") % 25 == 24) & (F.col("v") % 25 < 20)).alias("is_wall")
    room = F.expr("u between 2 and 97 and v between 2 and 97").alias("in_room")
    return px.select("session_id", "u", "v", "plane", (F.col("y_mm") / 1000.0).alias("y"), room, wall, *colour)


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, tilt, p, q, r): walls, floors, slopes and ceilings at dyadic coordinates."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as fid", "p_size % 5 as tilt")
    rows = rows.selectExpr("fid", "tilt", "(fid % 40) * 0.5D as x", "2.25D + 0.125D * (fid % 4) as y", "cast(fid div 40 as double) * 0.5D as z")
    by = F.expr("case tilt when 2 then 0.125D when 3 then 0.375D else 0D end")
    bx, bz = F.expr("case tilt when 1 then 0D else 0.5D end"), F.expr("case tilt when 1 then 0.5D else 0D end")
    cx, cy, cz = F.expr("case tilt when 1 then 0.5D else 0D end"), F.expr("case tilt when 0 then 0.25D else 0D end"), F.expr("case when tilt in (0, 1) then 0D else 0.5D end")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    point = lambda a, b, c: F.struct(a.alias("x"), b.alias("y"), c.alias("z"))
    return rows.select("fid", "tilt", point(x, y, z).alias("p"), point(x + bx, y + by, z + bz).alias("q"), point(x + cx, y + cy, z + cz).alias("r"))


FACES = """
fc0 as (
  select p_partkey as fid, p_size % 5 as tilt, (p_partkey % 40) * 0.5::double as x, 2.25::double + 0.125::double * (p_partkey % 4) as y, (p_partkey // 40)::double * 0.5::double as z from part
), fc as (
  select fid, tilt, x as px, y as py, z as pz,
    x + case tilt when 1 then 0 else 0.5 end::double as qx, y + case tilt when 2 then 0.125 when 3 then 0.375 else 0 end::double as qy, z + case tilt when 1 then 0.5 else 0 end::double as qz,
    x + case tilt when 1 then 0.5 else 0 end::double as rx, y + case tilt when 0 then 0.25 else 0 end::double as ry, z + case when tilt in (0, 1) then 0 else 0.5 end::double as rz
  from fc0
), fn as (
  select *, (qy - py) * (rz - pz) - (qz - pz) * (ry - py) as ax, (qz - pz) * (rx - px) - (qx - px) * (rz - pz) as ay, (qx - px) * (ry - py) - (qy - py) * (rx - px) as az from fc
), fg as (
  select *, sqrt(ax * ax + ay * ay + az * az) as len from fn
), fx as (
  select *, ax / case when len = 0 then 1 else len end as nx, ay / case when len = 0 then 1 else len end as ny, az / case when len = 0 then 1 else len end as nz, len / 2 as area,
    (px + qx + rx) / 3 as cx, (py + qy + ry) / 3 as cy, (pz + qz + rz) / 3 as cz from fg
)"""


def obj_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lineno, line): an OBJ text with quads, triangles and alternating materials."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    line = F.expr(
        """case o_orderkey % 7 when 0 then concat('usemtl m', cast(o_custkey % 3 as string)) when 1 then '# note' when 2 then concat('v ', cast(o_orderkey as string), ' 1 2')
        when 3 then concat('f ', cast(o_orderkey as string), ' ', cast(o_custkey as string), '/7 9//3 ', '4/5/6')
        when 4 then concat('f ', cast(o_custkey as string), '/1 2/2 3/3 4/4 5/5') else concat('f 1 2 ', cast(o_orderkey as string)) end"""
    )
    return rows.select(F.expr("cast(o_orderkey div 1000 as string)").alias("file"), F.col("o_orderkey").alias("lineno"), line.alias("line"))


OBJ = """
ol as (
  select (o_orderkey // 1000)::varchar as file, o_orderkey as lineno, case o_orderkey % 7 when 0 then 'usemtl m' || (o_custkey % 3) when 1 then '# note' when 2 then 'v ' || o_orderkey || ' 1 2'
    when 3 then 'f ' || o_orderkey || ' ' || o_custkey || '/7 9//3 4/5/6' when 4 then 'f ' || o_custkey || '/1 2/2 3/3 4/4 5/5' else 'f 1 2 ' || o_orderkey end as line from orders
)"""

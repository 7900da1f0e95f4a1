"""Registered queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import labels as text
from rasterloom.operators import compose, contract, distance, documents, drawing, heights, mesh, outline, periodic, raster, render, scoring, segment
from rasterloom.plans.adapters import FACES, OBJ, PIXELS, faces, obj_lines, pixels, scans
from rasterloom.sources import scans as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WIDTH, SEPARATION = 5, 100


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HIST = (
    PIXELS
    + """, edge as (select session_id, min(y_mm) - 5 as y0, max(y_mm) as y1 from px group by session_id), hist as (
  select b.session_id, b.y0, b.bin, coalesce(c.n, 0)::bigint as n from
    (select session_id, y0, unnest(range(0, (y1 - y0) // 5 + 2))::bigint as bin from edge where y0 is not null) b
    left join (select session_id, ((y_mm - y0) // 5)::bigint as bin, count(*) as n from px join edge using (session_id) where y_mm is not null group by all) c using (session_id, bin)
), smooth as (
  select *, 0.25 * lag(n, 1, 0) over w + 0.5 * n + 0.25 * lead(n, 1, 0) over w as s from hist window w as (partition by session_id order by bin)
)"""
)
PEAKS = (
    HIST
    + """, run as (select *, sum(new) over (partition by session_id order by bin) as r from (select *, case when s = lag(s) over (partition by session_id order by bin) then 0 else 1 end as new from smooth)),
flat as (select session_id, r, min(s) as s, (min(bin) + max(bin)) // 2 as i from run group by session_id, r),
cand as (select * from (select *, lag(s) over w as a, lead(s) over w as b from flat window w as (partition by session_id order by r)) where s > a and s > b),
greedy as (select session_id, list_reduce(list_concat([[]::bigint[]], list([i] order by s desc, i)), lambda acc, p: case when len(list_filter(acc, lambda k: abs(k - p[1]) < 20)) > 0 then acc else list_concat(acc, p) end) as kept from cand group by session_id),
kept as (select session_id, unnest(kept) as i from greedy),
higher as (select k.session_id, k.i, p.s, coalesce(max(h.bin) filter (where h.bin < k.i), -1) as l, coalesce(min(h.bin) filter (where h.bin > k.i), 1000000) as r
  from kept k join smooth p on p.session_id = k.session_id and p.bin = k.i left join smooth h on h.session_id = k.session_id and h.s > p.s group by k.session_id, k.i, p.s),
base as (select h.session_id, h.i, h.s, min(b.s) filter (where b.bin <= h.i) as lo, min(b.s) filter (where b.bin >= h.i) as hi
  from higher h join smooth b on b.session_id = h.session_id and b.bin > h.l and b.bin < h.r group by h.session_id, h.i, h.s),
top as (select session_id, max(s) as m, arg_min(bin, (-s, bin)) as best from smooth group by session_id),
good as (select b.session_id, b.i, b.s from base b join top t using (session_id) where b.s - greatest(b.lo, b.hi) >= 0.05 * t.m),
found as (select session_id, i, s from good union all select t.session_id, t.best, t.m from top t where t.session_id not in (select session_id from good)),
five as (select * from (select *, row_number() over (partition by session_id order by s desc, i) as k from found) where k <= 5),
peaks as (select session_id, (row_number() over (partition by session_id order by i) - 1)::int as peak, i::bigint as bin, s, y0 + 5 * (i + 0.5) as y from five join edge using (session_id))"""
)
ASSIGN = PEAKS + """, assigned as (select px.*, (select arg_min(p.peak, (abs(px.y_mm - p.y), p.peak)) from peaks p where p.session_id = px.session_id and px.y_mm is not null) as label from px)"""


@query(f"with {HIST} select session_id, y0, bin, n from hist")
def height_histogram(spark, sf_dir):
    return heights.histogram(pixels(spark, sf_dir), "y_mm", WIDTH)


@query(f"with {PEAKS} select session_id, peak, bin, s::double as s, y::double as y from peaks")
def height_peaks(spark, sf_dir):
    return heights.peaks(pixels(spark, sf_dir), "y_mm", WIDTH, SEPARATION)


def _assigned(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return heights.assign(px, heights.peaks(px, "y_mm", WIDTH, SEPARATION), "y_mm")


@query(f"with {ASSIGN} select session_id, u, v, label from assigned")
def nearest_plane(spark, sf_dir):
    return _assigned(spark, sf_dir).select("session_id", "u", "v", "label")


@query(f"with {PIXELS} select session_id, u, v, case when y_mm between 2380 and 2420 then 0 when y_mm between 2540 and 2560 and abs(y_mm - 2550) <= abs(y_mm - 2555) then 1 when y_mm between 2545 and 2565 then 2 when y_mm between 2540 and 2560 then 1 else -1 end as band from px")
def band_assign(spark, sf_dir):
    bands = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit((a + b) // 2).alias("mid"), F.lit(b).alias("hi")) for a, b in ((2380, 2420), (2540, 2560), (2545, 2565))))
    px = pixels(spark, sf_dir)
    return px.select("session_id", "u", "v", F.when(F.col("y_mm").isNotNull(), heights.band(F.col("y_mm"), bands)).otherwise(F.lit(-1)).alias("band"))


STATS = "round(avg(y_mm), 6) as mean_y, round(stddev_pop(y_mm), 6) as std_y, min(y_mm)::double as min_y, max(y_mm)::double as max_y, count(y_mm) as n_valid, count(*) as n_total, round(count(y_mm) / count(*), 6) as valid_frac"


@query(f"with {PIXELS} select session_id, plane, {STATS} from px group by session_id, plane")
def plane_stats(spark, sf_dir):
    return heights.stats(pixels(spark, sf_dir), ["session_id", "plane"], "y_mm")


@query(f"with {PIXELS}, nr as (select session_id, plane, case when abs(y_mm - (2410 + 150 * plane)) <= 5 then y_mm end as y_mm from px) select session_id, plane, {STATS} from nr group by session_id, plane")
def band_stats(spark, sf_dir):
    return heights.band_stats(pixels(spark, sf_dir), ["session_id", "plane"], "y_mm", 2410 + 150 * F.col("plane"), 5)


@query(f"with {PIXELS}, st as (select session_id, plane, round(avg(y_mm), 6) as mean_y from px group by all) select s.session_id, s.plane, round(s.mean_y - m.mean_y, 6) as relative_y from st s left join st m on m.session_id = s.session_id and m.plane = 0")
def relative_height(spark, sf_dir):
    st = heights.stats(pixels(spark, sf_dir), ["session_id", "plane"], "y_mm")
    return heights.relative(st, st.filter("plane = 0")).select("session_id", "plane", F.round("relative_y", 6).alias("relative_y"))


@query(f"with {PIXELS} select session_id, min(y_mm)::double as min_y, max(y_mm)::double as max_y, median(y_mm)::double as median_y, count(y_mm) as valid_px, count(*) as total_px from px group by session_id")
def height_summary(spark, sf_dir):
    return heights.summary(pixels(spark, sf_dir), "y_mm")


BANDS = "select (l_orderkey % 50)::bigint as session_id, (l_partkey % 1000)::bigint as y, min((l_partkey % 1000) - l_suppkey % 4)::bigint as y_lo, max((l_partkey % 1000) + l_suppkey % 4)::bigint as y_hi, sum(l_linenumber)::bigint as area from lineitem where l_linenumber = 1 group by all"


@query(
    f"""with recursive b as (select *, row_number() over (partition by session_id order by y, y_lo, y_hi, area) as k from ({BANDS})), f as (
  select session_id, k, y, y_lo, y_hi, area, 0 as cluster from b where k = 1
  union all
  select b.session_id, b.k, case when b.y_lo <= f.y_hi and b.area <= f.area then f.y else b.y end, case when b.y_lo <= f.y_hi then least(f.y_lo, b.y_lo) else b.y_lo end,
    case when b.y_lo <= f.y_hi then greatest(f.y_hi, b.y_hi) else b.y_hi end, case when b.y_lo <= f.y_hi then f.area + b.area else b.area end, case when b.y_lo <= f.y_hi then f.cluster else f.cluster + 1 end
  from f join b on b.session_id = f.session_id and b.k = f.k + 1)
select session_id, cluster, arg_max(y, k) as y, arg_max(y_lo, k) as y_lo, arg_max(y_hi, k) as y_hi, arg_max(area, k) as area from f group by session_id, cluster"""
)
def band_merge(spark, sf_dir):
    return _merged(spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 1"))


@query(SQL["band_merge"].replace(BANDS, BANDS.replace(" where l_linenumber = 1", "")))
def band_merge_all(spark, sf_dir):
    """``band_merge`` over every row of the table."""
    return _merged(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def _merged(rows):
    y, half = F.col("l_partkey") % 1000, F.col("l_suppkey") % 4
    bands = rows.groupBy((F.col("l_orderkey") % 50).alias("session_id"), y.alias("y")).agg(F.min(y - half).alias("y_lo"), F.max(y + half).alias("y_hi"), F.sum("l_linenumber").alias("area"))
    return heights.merge_bands(bands)


def _geometry(spark, sf_dir):
    return mesh.geometry(faces(spark, sf_dir))


@query(f"with {FACES} select fid, round(nx, 6) as nx, round(ny, 6) as ny, round(nz, 6) as nz, round(area, 6) as area, round(cx, 6) as cx, round(cy, 6) as cy, round(cz, 6) as cz from fx")
def face_geometry(spark, sf_dir):
    return _geometry(spark, sf_dir).select("fid", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "area", "cx", "cy", "cz")))


@query(f"with {FACES} select fid, round(area, 6) as area from fx where ny < -cos(radians(30))")
def downward_faces(spark, sf_dir):
    return mesh.downward(_geometry(spark, sf_dir)).select("fid", F.round("area", 6).alias("area"))


@query(f"with {FACES}, m as (select median(py) as h from fx where ny < -cos(radians(30))) select fid from fx, m where abs(ny) < sin(radians(15)) and greatest(py, qy, ry) - least(py, qy, ry) < 0.6 and least(abs(py - h), abs(qy - h), abs(ry - h)) < 0.2")
def wall_faces(spark, sf_dir):
    rows = _geometry(spark, sf_dir)
    ceiling = mesh.downward(rows).agg(F.median("p.y").alias("h"))
    return mesh.wall_edges(rows.join(F.broadcast(ceiling)), F.col("h"), near=0.2).select("fid")


@query(f"with {FACES} select min(least(px, qx, rx)) - 0.5 as min_x, max(greatest(px, qx, rx)) + 0.5 as max_x, min(least(pz, qz, rz)) - 0.5 as min_z, max(greatest(pz, qz, rz)) + 0.5 as max_z, 4::double as pixels_per_metre, ceil((max(greatest(px, qx, rx)) - min(least(px, qx, rx)) + 1) * 4)::int as width, ceil((max(greatest(pz, qz, rz)) - min(least(pz, qz, rz)) + 1) * 4)::int as height from fx where ny < -cos(radians(30))")
def grid_extent(spark, sf_dir):
    return mesh.grid(mesh.downward(_geometry(spark, sf_dir)), 4, 0.5)


@query(f"with {FACES} select floor(cx * 8) as u, floor(cz * 8) as v, arg_min(fid, (cy::float, fid)) as fid, min(cy::float)::double as cy from fx group by 1, 2")
def zbuffer(spark, sf_dir):
    px = _geometry(spark, sf_dir).select(F.floor(F.col("cx") * 8).cast("double").alias("u"), F.floor(F.col("cz") * 8).cast("double").alias("v"), "cy", "fid")
    return mesh.z_buffer(px, ["u", "v"], "cy", "fid", []).withColumn("cy", F.col("cy").cast("double"))


@query()
def height_map(spark, sf_dir):
    down = mesh.downward(_geometry(spark, sf_dir)).select("fid", "p", "q", "r", "cy")
    row = mesh.grid(down, 8)
    px = mesh.rasterize(down.join(F.broadcast(row)), F.col("max_x"), F.col("max_z"), 8.0)
    return mesh.z_buffer(px, ["u", "v"], "cy", "fid", [])


#: Faces with texture corners at eighths, in closed form: a triangle of whole 4-pixel legs.
TEXTURED = FACES + """, gx as (select min(least(px, qx, rx)) - 0.5 as x0, max(greatest(px, qx, rx)) + 0.5 as x1, min(least(pz, qz, rz)) - 0.5 as z0, max(greatest(pz, qz, rz)) + 0.5 as z1 from fx),
ft as (select fx.*, fid % 4 as mat, (fid % 8) / 8.0::double as pu, (fid % 5) / 8.0::double as pv, (fid % 8 + 3) / 8.0::double as qu, (fid % 3) / 8.0::double as qv, (fid % 7) / 8.0::double as ru, (fid % 5 + 2) / 8.0::double as rv,
  ((x1 - px) * 8)::int as u0, ((z1 - pz) * 8)::int as v0, cy::float as y from fx, gx where tilt <> 0 and fid % 4 < 3),
dp as (select fid, mat, y, case tilt when 1 then u0 - j else u0 - i end as u, case tilt when 1 then v0 - i else v0 - j end as v,
  16 * (pu + (qu - pu) * i / 4 + (ru - pu) * j / 4) as sx, 16 * (1 - (pv + (qv - pv) * i / 4 + (rv - pv) * j / 4)) as sy from ft, unnest(range(0, 5)) a(i), unnest(range(0, 5)) b(j) where i + j <= 4),
wn as (select u, v, arg_min(struct_pack(fid := fid, mat := mat, y := y, sx := sx, sy := sy), (y, fid)) as w from dp group by u, v),
tx as (select (c_custkey // 256 % 3) as mat, c_custkey % 16 as tu, c_custkey // 16 % 16 as tv, max(c_custkey * 37 % 256) as r, max(c_custkey * 11 % 256) as g, max(c_custkey * 5 % 256) as b from customer group by all),
sm as (select u, v, w, floor(w.sx) + i as x, floor(w.sy) + j as z, case i when 1 then w.sx - floor(w.sx) else 1 - w.sx + floor(w.sx) end * case j when 1 then w.sy - floor(w.sy) else 1 - w.sy + floor(w.sy) end as k from wn, unnest(range(0, 2)) a(i), unnest(range(0, 2)) b(j)),
rf as (select u, v, w, k, case when x % 32 + case when x % 32 < 0 then 32 else 0 end < 16 then x % 32 + case when x % 32 < 0 then 32 else 0 end else 31 - x % 32 - case when x % 32 < 0 then 32 else 0 end end as tu,
  case when z % 32 + case when z % 32 < 0 then 32 else 0 end < 16 then z % 32 + case when z % 32 < 0 then 32 else 0 end else 31 - z % 32 - case when z % 32 < 0 then 32 else 0 end end as tv from sm)"""


@query(
    f"with {TEXTURED} select u, v, any_value(w.y)::double as y, any_value(w.fid) as fid, floor(sum(coalesce(k * r, 0)) + 0.5)::int as r, floor(sum(coalesce(k * g, 0)) + 0.5)::int as g, floor(sum(coalesce(k * b, 0)) + 0.5)::int as b from rf left join tx on tx.mat = rf.w.mat and tx.tu = rf.tu and tx.tv = rf.tv group by u, v"
)
def textured_render(spark, sf_dir):
    rows = _geometry(spark, sf_dir).withColumn("key", F.lit(0))
    point = lambda u, v: F.struct(F.expr(f"({u}) / 8.0D").alias("u"), F.expr(f"({v}) / 8.0D").alias("v"))
    rows = rows.withColumns({"mat": F.expr("cast(fid % 4 as int)"), "tp": point("fid % 8", "fid % 5"), "tq": point("fid % 8 + 3", "fid % 3"), "tr": point("fid % 7", "fid % 5 + 2")})
    rows = rows.join(F.broadcast(mesh.grid(rows, 8, 0.5, by=("key",))), "key")
    texels = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("0 key", "cast(c_custkey div 256 % 3 as int) mat", "cast(c_custkey % 16 as int) tu", "cast(c_custkey div 16 % 16 as int) tv", "c_custkey k")
    texels = texels.groupBy("key", "mat", "tu", "tv").agg(*(F.max(F.col("k") * f % 256).alias(c) for c, f in (("r", 37), ("g", 11), ("b", 5))))
    materials = spark.createDataFrame([(0, m, 16, 16) for m in range(3)], "key int, mat int, tw int, th int")
    made = render.textured(rows.select("key", "fid", "mat", "p", "q", "r", "tp", "tq", "tr", "max_x", "max_z", "width", "height"), materials, texels, 8.0)
    return made.drop("key").withColumn("y", F.col("y").cast("double"))


TRI = OBJ + """, w as (select file, lineno, string_split(line, ' ') as w from ol), m as (select file, w[2] as name, (row_number() over (partition by file order by min(lineno)) - 1)::int as mat from w where w[1] = 'usemtl' group by file, w[2]),
g as (select file, lineno, w, last_value(case when w[1] = 'usemtl' then w[2] end ignore nulls) over (partition by file order by lineno) as name from w where w[1] in ('usemtl', 'f')),
p as (select g.file, g.lineno, coalesce(m.mat, -1) as mat, list_transform(g.w[2:], lambda x: string_split(x, '/')) as c from g left join m on m.file = g.file and m.name = g.name where g.w[1] = 'f'),
t as (select *, unnest(range(1, len(c) - 1))::int as part from p),
tri as (select file, (row_number() over (partition by file order by lineno, part) - 1)::bigint as fid, lineno, part, mat,
  list_transform([c[1], c[part + 1], c[part + 2]], lambda k: k[1]::bigint - 1) as v, list_transform([c[1], c[part + 1], c[part + 2]], lambda k: coalesce(try_cast(k[2] as bigint), k[1]::bigint) - 1) as t from t)"""


@query(f"with {TRI} select file, fid, part, v[1] as v0, v[2] as v1, v[3] as v2, t[1] as t0, t[2] as t1, t[3] as t2 from tri")
def fan_triangulate(spark, sf_dir):
    tri = source.faces(obj_lines(spark, sf_dir))
    return tri.select("file", "fid", "part", *(F.element_at(c, k + 1).alias(f"{c}{k}") for c in "vt" for k in range(3)))


@query(f"with {TRI} select file, lineno, mat, count(*) as n from tri group by all")
def material_fill(spark, sf_dir):
    return source.faces(obj_lines(spark, sf_dir)).groupBy("file", "lineno", "mat").agg(F.count("*").alias("n"))


@query(f"with {TRI}, vn as (select file, count(*) as n_verts from ol where starts_with(line, 'v ') group by file), tn as (select file, count(*) as n_tris from tri group by file) select file, coalesce(n_verts, 0) as n_verts, coalesce(n_tris, 0) as n_tris from vn full join tn using (file)")
def mesh_counts(spark, sf_dir):
    lines = obj_lines(spark, sf_dir)
    return mesh.counts(source.vertices(lines), source.faces(lines))


@query(f"with {FACES} select min(least(py, qy, ry)) as min_y, max(greatest(py, qy, ry)) as max_y from fx")
def y_range(spark, sf_dir):
    return mesh.y_range(faces(spark, sf_dir))


@query()
def wall_raster(spark, sf_dir):
    rows = _geometry(spark, sf_dir).withColumn("session_id", F.col("fid") % 8)
    down = mesh.downward(rows)
    row = down.groupBy("session_id").agg(F.median("cy").alias("h"))
    row = row.join(mesh.grid(down, 8, by=("session_id",)), "session_id")
    return mesh.wall_raster(rows.join(row, "session_id"), F.col("h"), 8.0, "session_id")


@query()
def legacy_segmentation(spark, sf_dir):
    rows = faces(spark, sf_dir).withColumn("session_id", F.col("fid") % 8)
    return segment.segment_ceiling(rows, 8.0, least_m2=0.1)


#: A room, an L and a triangle, in metres.
ROOM = [(0, 0), (6, 0), (6, 4), (0, 4)]
ELL = [(0, 0), (5, 0), (5, 2), (2, 2), (2, 5), (0, 5)]
SHIFT = "(c_custkey % 7)"


def _polygons(spark, sf_dir):
    """(id, x, z, poly): an L moved by the customer, and a point."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    d = (F.col("c_custkey") % 7).cast("double")
    poly = F.transform(geo.polygon(ELL), lambda p: F.struct((p["x"] + d).alias("x"), p["z"].alias("z")))
    return rows.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12 + 0.25).cast("double").alias("x"), (F.col("c_custkey") % 5 + 0.5).cast("double").alias("z"), poly.alias("poly"))


POLY = (
    "cs as (select c_custkey as id, (c_custkey % 12 + 0.25)::double as x, (c_custkey % 5 + 0.5)::double as z, (c_custkey % 7)::double as d from customer), "
    f"vx as (select id, x, z, d, i, a[1]::double + d as ax, a[2]::double as az, b[1]::double + d as bx, b[2]::double as bz from (select *, unnest(range(0, 6))::int as i from cs) join (select unnest(range(0, 6))::int as i, unnest({[list(p) for p in ELL]}) as a, unnest({[list(p) for p in ELL[1:] + ELL[:1]]}) as b) using (i))"
)


@query(f"with {POLY} select id, abs(sum(ax * bz - bx * az)) / 2 as area, round(avg(ax), 9) as mean_x, round(avg(az), 9) as mean_z, min(ax) - 0.5 as min_x, max(ax) + 0.5 as max_x from vx group by id")
def polygon_area(spark, sf_dir):
    rows = _polygons(spark, sf_dir).select("id", geo.area("poly").alias("area"), geo.vertex_mean("poly").alias("m"), geo.extent("poly").alias("e"))
    return rows.select("id", "area", F.round("m.x", 9).alias("mean_x"), F.round("m.z", 9).alias("mean_z"), "e.min_x", "e.max_x")


@query(f"with {POLY} select id, (sum(case when (az > z) <> (bz > z) and x < (bx - ax) * (z - az) / case when bz = az then 1 else bz - az end + ax then 1 else 0 end) % 2 = 1) as inside from vx group by id")
def polygon_contains(spark, sf_dir):
    return _polygons(spark, sf_dir).select("id", geo.contains("poly", F.col("x"), F.col("z")).alias("inside"))


@query(f"with {POLY}, t as (select *, least(greatest(((x - ax) * (bx - ax) + (z - az) * (bz - az)) / ((bx - ax) ^ 2 + (bz - az) ^ 2), 0), 1) as t from vx), e as (select *, sqrt((x - ax - t * (bx - ax)) ^ 2 + (z - az - t * (bz - az)) ^ 2) as de, sqrt((x - ax) ^ 2 + (z - az) ^ 2) as dv from t) select id, arg_min(i, (round(de, 9), i)) as edge, round(min(de), 6) as edge_distance, arg_min(i, (round(dv, 9), i)) as vertex, round(min(dv), 6) as vertex_distance from e group by id")
def closest_edge(spark, sf_dir):
    x, z = F.col("x"), F.col("z")
    rows = _polygons(spark, sf_dir).select("id", geo.closest_edge("poly", x, z).alias("e"), geo.closest_vertex("poly", x, z).alias("v"))
    return rows.select("id", F.col("e.i").alias("edge"), F.round("e.distance", 6).alias("edge_distance"), F.col("v.i").alias("vertex"), F.round("v.distance", 6).alias("vertex_distance"))


@query(
    f"""with {POLY}, c as (select *, avg(ax) over (partition by id) as cx, avg(az) over (partition by id) as cz, sqrt((bx - ax) ^ 2 + (bz - az) ^ 2) as len from vx),
n as (select *, -(bz - az) / len as nx, (bx - ax) / len as nz, (ax + bx) / 2 as mx, (az + bz) / 2 as mz, degrees(atan2(bz - az, bx - ax)) as turn from c where len >= 0.001),
s as (select *, case when nx * (mx - cx) + nz * (mz - cz) < 0 then -1 else 1 end as side from n)
select id, i, round_even(len * 1000, 0)::bigint as length_mm, round(mx + side * nx * 0.18, 6) as x, round(mz + side * nz * 0.18, 6) as z, round(case when turn > 90 then turn - 180 when turn < -90 then turn + 180 else turn end, 6) as angle from s"""
)
def room_edges(spark, sf_dir):
    rows = _polygons(spark, sf_dir).select("id", F.explode(geo.dimensions("poly")).alias("d"))
    return rows.select("id", "d.i", "d.length_mm", *(F.round(f"d.{c}", 6).alias(c) for c in ("x", "z", "angle")))


def _flat(name: str, value) -> list:
    p = F.transform(value, lambda v: F.concat_ws(" ", v["x"].cast("string"), v["z"].cast("string")))
    return [F.size(value).alias(f"{name}_n"), F.array_join(p, ",").alias(name)]


EDIT = f"with {POLY}, b as (select id, list(ax || ' ' || az order by i) as p, (id % 6)::int as k, any_value(x || ' ' || z) as q from vx group by id)"


@query(f"{EDIT} select id, 7 as added_n, array_to_string(list_concat(list_append(p[1:k + 1], q), p[k + 2:]), ',') as added from b")
def polygon_edit_insert(spark, sf_dir):
    rows = _polygons(spark, sf_dir)
    return rows.select("id", *_flat("added", geo.insert_vertex("poly", (F.col("id") % 6).cast("int"), F.struct("x", "z"))))


@query(f"{EDIT} select id, 6 as moved_n, array_to_string(list_concat(list_append(p[1:k], q), p[k + 2:]), ',') as moved from b")
def polygon_edit_move(spark, sf_dir):
    rows = _polygons(spark, sf_dir)
    return rows.select("id", *_flat("moved", geo.move_vertex("poly", (F.col("id") % 6).cast("int"), F.struct("x", "z"))))


@query(f"{EDIT} select id, 5 as cut_n, array_to_string(list_concat(p[1:k], p[k + 2:]), ',') as cut from b")
def polygon_edit_delete(spark, sf_dir):
    return _polygons(spark, sf_dir).select("id", *_flat("cut", geo.delete_vertex("poly", (F.col("id") % 6).cast("int"))))


@query(f"{EDIT}, c as (select id, case when k + 2 < 6 then list_concat(p[1:k + 1], p[k + 3:]) else p[k + 2 - 6 + 1:k + 1] end as r from b) select id, len(r)::int as chain_n, array_to_string(r, ',') as chain from c")
def polygon_edit_chain(spark, sf_dir):
    k = (F.col("id") % 6).cast("int")
    return _polygons(spark, sf_dir).select("id", *_flat("chain", geo.delete_chain("poly", k, (k + 2) % 6)))


NEIGHBOURS = "(select a.s as du, b.s as dv from (select unnest(range(-3, 4))::int as s) a, (select unnest(range(-3, 4))::int as s) b)"
BOX = "bx as (select session_id, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from px group by session_id)"
DENSE = "lb as (select session_id, u, v, case when (u * 7 + v * 13) % 11 = 0 then (plane + 1) % 4 else plane end as label from px)"


def _noisy(spark, sf_dir):
    label = F.expr("case when (u * 7 + v * 13) % 11 = 0 then (plane + 1) % 4 else plane end")
    return pixels(spark, sf_dir).select("session_id", "u", "v", label.alias("label"))


@query(f"with {PIXELS}, {BOX}, {DENSE} select p.session_id, p.u, p.v, quantile_disc(q.label, 0.5)::int as label from lb p join bx using (session_id), {NEIGHBOURS} n join lb q on q.session_id = p.session_id and q.u = least(greatest(p.u + n.du, u0), u1) and q.v = least(greatest(p.v + n.dv, v0), v1) group by all")
def median_filter(spark, sf_dir):
    return raster.median_filter(_noisy(spark, sf_dir), "label", 3)


#: 40 labels that are no ranks, and none, in one scan.
MANY = "lm as (select session_id, u, v, case when (u * 7 + v * 13) % 23 = 0 then null else ((u // 9 + v // 7 * 5 + (u * 11 + v * 3) % 4) % 40) * 3 - 50 end::int as label from px)"
SQUARE15 = "(select a.s as du, b.s as dv from (select unnest(range(-7, 8))::int as s) a, (select unnest(range(-7, 8))::int as s) b)"


@query(
    f"with {PIXELS}, {BOX}, {MANY}, sq as materialized (select session_id, u, v, least(greatest(u + du, u0), u1) as nu, least(greatest(v + dv, v0), v1) as nv from lm join bx using (session_id), {SQUARE15}), lq as materialized (select session_id, u as nu, v as nv, coalesce(label, 1000) as label from lm) "
    "select session_id, u, v, nullif(quantile_disc(label, 0.5), 1000)::int as label from sq join lq using (session_id, nu, nv) group by session_id, u, v"
)
def median_filter_labels(spark, sf_dir):
    label = F.expr("case when (u * 7 + v * 13) % 23 = 0 then null else cast(((u div 9 + v div 7 * 5 + (u * 11 + v * 3) % 4) % 40) * 3 - 50 as int) end")
    return raster.median_filter(pixels(spark, sf_dir).select("session_id", "u", "v", label.alias("label")), "label", 7)


MASK = "mk as (select session_id, u, v from px where y_mm is null)"


def _holes(spark, sf_dir):
    return pixels(spark, sf_dir).filter("y_mm is null").select("session_id", "u", "v")


CROSS = "(select * from (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(du, dv))"


@query(f"with {PIXELS}, {MASK} select distinct session_id, (u + du)::int as u, (v + dv)::int as v from mk, {CROSS}")
def dilate(spark, sf_dir):
    return raster.dilate(_holes(spark, sf_dir), raster.CROSS)


@query(f"with {PIXELS}, {MASK}, d as (select distinct session_id, u + du as u, v + dv as v from mk, {CROSS}) select session_id, (u - du)::int as u, (v - dv)::int as v from d, {CROSS} group by 1, 2, 3 having count(*) = 5")
def close(spark, sf_dir):
    return raster.close(_holes(spark, sf_dir), raster.CROSS)


DISC = "(select a.s as du, b.s as dv from (select unnest(range(-4, 5))::int as s) a, (select unnest(range(-4, 5))::int as s) b where a.s * a.s + b.s * b.s <= 18)"


@query(f"with {PIXELS}, {MASK}, d as (select distinct session_id, u + du as u, v + dv as v from mk, {DISC}) select session_id, (u - du)::int as u, (v - dv)::int as v from d, {DISC} group by 1, 2, 3 having count(*) = (select count(*) from {DISC})")
def close_ellipse(spark, sf_dir):
    return raster.close(_holes(spark, sf_dir), raster.disc(4))


@query(
    f"""with {PIXELS}, g as (select session_id, u, v, plane * 10 + u % 3 as y from px), a as (select *, coalesce(lag(y) over h, lead(y) over h) as lo, coalesce(lead(y) over h, lag(y) over h) as hi from g window h as (partition by session_id, v order by u)),
b as (select session_id, u, v, hi - lo as d, lo + 2 * y + hi as s from a), c as (select *, coalesce(lag(d) over k, lead(d) over k) as da, coalesce(lead(d) over k, lag(d) over k) as db, coalesce(lag(s) over k, lead(s) over k) as sa, coalesce(lead(s) over k, lag(s) over k) as sb from b window k as (partition by session_id, u order by v))
select session_id, u, v, da + 2 * d + db as gx, sb - sa as gy from c"""
)
def gradient(spark, sf_dir):
    rows = pixels(spark, sf_dir).select("session_id", "u", "v", F.expr("plane * 10 + u % 3").alias("y"))
    return raster.gradient(rows, "y").select("session_id", "u", "v", "gx", "gy")


RUNS = """rn0 as (select session_id, v, u, label, u - row_number() over (partition by session_id, v, label order by u) as isl from cc),
rn as (select session_id, v, label, min(u) as a, max(u) as b, v * 1048576::bigint + min(u) as run from rn0 group by session_id, v, label, isl),
adj as (select x.session_id, x.run as p, y.run as q from rn x join rn y on x.session_id = y.session_id and x.label = y.label and x.v = y.v + 1 and x.a <= y.b + 1 and y.a <= x.b + 1),
ed as (select * from adj union all select session_id, q, p from adj),
reach as (select session_id, run as p, run as q from rn union select r.session_id, r.p, e.q from reach r join ed e on e.session_id = r.session_id and e.p = r.q),
top as (select session_id, p, min(q) as comp from reach group by session_id, p)"""
COMPS = f"with recursive {PIXELS}, cc as (select session_id, u, v, plane as label from px where y_mm is not null), {RUNS}"


def _components(spark, sf_dir):
    seen = pixels(spark, sf_dir).withColumn("label", F.when(F.col("y_mm").isNotNull(), F.col("plane")))
    return raster.components(seen)


@query(f"{COMPS} select rn.session_id, u::int as u, rn.v, rn.label, comp from rn join top on top.session_id = rn.session_id and top.p = rn.run, unnest(range(rn.a::bigint, rn.b::bigint + 1)) t(u)")
def components(spark, sf_dir):
    return _components(spark, sf_dir)


@query(f"{COMPS} select rn.session_id, rn.label, comp, sum(b - a + 1)::bigint as area, min(a) as u0, min(v) as v0, (max(b) + 1)::int as u1, (max(v) + 1)::int as v1 from rn join top on top.session_id = rn.session_id and top.p = rn.run group by rn.session_id, rn.label, comp")
def component_stats(spark, sf_dir):
    return raster.component_stats(_components(spark, sf_dir))


BLOCK = "blk as (select session_id, u, v, (u // 10 + 10 * (v // 10))::int as label, y_mm from px)"
ADJ = f"with recursive {PIXELS}, {BLOCK}, aj as (select distinct x.session_id, least(x.label, y.label) as a, greatest(x.label, y.label) as b from blk x join blk y on x.session_id = y.session_id and ((y.u = x.u + 1 and y.v = x.v) or (y.v = x.v + 1 and y.u = x.u)) and x.label <> y.label)"


def _blocks(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("label", F.expr("cast(u div 10 + 10 * (v div 10) as int)"))


@query(f"{ADJ} select * from aj")
def adjacency(spark, sf_dir):
    return raster.adjacency(_blocks(spark, sf_dir))


@query(
    f"""{ADJ}, mn as (select session_id, label, avg(y_mm) as m from blk group by all), cl as (select aj.session_id, a, b from aj join mn x on x.session_id = aj.session_id and x.label = a join mn y on y.session_id = aj.session_id and y.label = b where abs(x.m - y.m) < 20),
e as (select session_id, a, b from cl union all select session_id, b, a from cl), r as (select session_id, label as a, label as b from mn union select r.session_id, r.a, e.b from r join e on e.session_id = r.session_id and e.a = r.b)
select session_id, a as label, min(b) as merged from r group by session_id, a"""
)
def merge_by_height(spark, sf_dir):
    return raster.merge_by_height(_blocks(spark, sf_dir), "y_mm", 20)


@query(f"with {PIXELS} select session_id, u, v, case when y_mm is not null then (dense_rank() over (partition by session_id order by case when y_mm is not null then plane * 10 + u % 2 end nulls last) - 1)::int end as compact from px")
def compact_labels(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("label", F.expr("case when y_mm is not null then plane * 10 + u % 2 end"))
    return raster.compact(rows).select("session_id", "u", "v", "compact")


@query(f"with {PIXELS}, sn as (select * from px where y_mm is not null) select p.session_id, p.u, p.v, coalesce((select arg_min(s.plane, ((s.u - p.u) ^ 2 + (s.v - p.v) ^ 2, s.v, s.u)) from sn s where s.session_id = p.session_id and abs(s.u - p.u) <= 12 and abs(s.v - p.v) <= 12), -1)::int as label from px p")
def nearest_fill(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("label", F.when(F.col("y_mm").isNotNull(), F.col("plane")))
    return raster.nearest_fill(rows).withColumn("label", F.coalesce("label", F.lit(-1)))


@query(f"with {PIXELS}, sn as (select * from px where (u + 3 * v) % 97 = 0) select p.session_id, p.u, p.v, (select arg_min(s.v * 1000 + s.u, ((s.u - p.u) ^ 2 + (s.v - p.v) ^ 2, s.v, s.u)) from sn s where s.session_id = p.session_id)::int as label from px p")
def nearest_fill_sparse(spark, sf_dir):
    """Labels far apart, each its own place."""
    label = F.expr("case when (u + 3 * v) % 97 = 0 then v * 1000 + u end")
    return raster.nearest_fill(pixels(spark, sf_dir).withColumn("label", label)).withColumn("label", F.col("label").cast("int"))


#: A triangle for each supplier, dealt over the four quarters of a scan.
TRIANGLES = """tg as (select (s_suppkey % 4)::int as session_id, s_suppkey as region, (s_suppkey * 37 % 50 + 0.25)::double as au, (s_suppkey * 61 % 50 + 0.5)::double as av, (s_suppkey * 37 % 50 + s_suppkey % 7 + 0.75)::double as bu, (s_suppkey * 61 % 50 + 1)::double as bv, (s_suppkey * 37 % 50 + 2)::double as cu, (s_suppkey * 61 % 50 + s_suppkey % 5 + 2.5)::double as cv from supplier),
sg as (select session_id, region, au, av, bu, bv from tg union all select session_id, region, bu, bv, cu, cv from tg union all select session_id, region, cu, cv, au, av from tg)"""


@query(
    f"""with {PIXELS}, {TRIANGLES}, hl as (select distinct (2 * (v // 50) + u // 50)::int as session_id, u % 50 as u, v % 50 as v from px where y_mm is null),
pt as (select session_id, u, v, region, au, av, bu - au as du, bv - av as dv from hl join sg using (session_id)),
tt as (select *, case when du * du + dv * dv = 0 then 0 else greatest(0::double, least(1::double, ((u::double - au) * du + (v::double - av) * dv) / (du * du + dv * dv))) end as t from pt),
dd as (select session_id, u, v, region, u::double - (au + t * du) as x, v::double - (av + t * dv) as y from tt)
select session_id, u, v, arg_min(region, (x * x + y * y, region)) as region, round(min(x * x + y * y), 6) as d2 from dd group by session_id, u, v"""
)
def nearest_polygon(spark, sf_dir):
    holes = pixels(spark, sf_dir).filter("y_mm is null").selectExpr("cast(2 * (v div 50) + u div 50 as int) session_id", "u % 50 u", "v % 50 v").distinct()
    corner = lambda u, v: F.struct(F.expr(f"cast({u} as double)").alias("u"), F.expr(f"cast({v} as double)").alias("v"))
    u, v = "s_suppkey * 37 % 50", "s_suppkey * 61 % 50"
    poly = F.array(corner(f"{u} + 0.25", f"{v} + 0.5"), corner(f"{u} + s_suppkey % 7 + 0.75", f"{v} + 1"), corner(f"{u} + 2", f"{v} + s_suppkey % 5 + 2.5"))
    shapes = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.expr("cast(s_suppkey % 4 as int)").alias("session_id"), F.col("s_suppkey").alias("region"), poly.alias("poly"))
    return distance.nearest_polygon(holes, shapes).withColumn("d2", F.round("d2", 6))


@query("select (e.user_id % 50) as session_id, (e.user_id % 17)::int as label from events e where not exists (select 1 from orders o where o.o_custkey % 50 = e.user_id % 50 and o.o_custkey % 11 = e.user_id % 17) group by all")
def unmatched_labels(spark, sf_dir):
    """Labels 11 to 16 have no partner at all."""
    a = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 50 session_id", "cast(user_id % 17 as int) label")
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 50 session_id", "cast(o_custkey % 11 as int) label").distinct()
    return scoring.unmatched(a, b, "label")


#: Scans of 50 by 50 pixels, so that small tables hold several too.
QUARTERS = PIXELS + ", qx as (select session_id * 4 + 2 * (v // 50) + u // 50 as session_id, u % 50 as u, v % 50 as v, plane, y_mm from px)"


def _quarters(spark, sf_dir):
    rows = pixels(spark, sf_dir)
    scan = F.expr("session_id * 4 + 2 * (v div 50) + u div 50")
    return rows.select(scan.alias("session_id"), (F.col("u") % 50).alias("u"), (F.col("v") % 50).alias("v"), "plane", "y_mm")


@query(f"with {QUARTERS}, sn as (select * from qx where y_mm is not null and (u * v) % 3 = session_id % 3) select p.session_id, p.u, p.v, (select arg_min(s.plane, ((s.u - p.u) ^ 2 + (s.v - p.v) ^ 2, s.v, s.u)) from sn s where s.session_id = p.session_id)::int as label from qx p")
def nearest_fill_scans(spark, sf_dir):
    label = F.when(F.col("y_mm").isNotNull() & ((F.col("u") * F.col("v")) % 3 == F.col("session_id") % 3), F.col("plane"))
    return raster.nearest_fill(_quarters(spark, sf_dir).withColumn("label", label))


@query(
    f"with {QUARTERS}, lq as materialized (select session_id, u as nu, v as nv, (plane + (u * v + session_id) % 3)::int as label from qx), bq as (select session_id, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from qx group by session_id), sq as materialized (select session_id, u, v, least(greatest(u + du, u0), u1) as nu, least(greatest(v + dv, v0), v1) as nv from qx join bq using (session_id), {NEIGHBOURS}) "
    "select session_id, u, v, quantile_disc(label, 0.5)::int as label from sq join lq using (session_id, nu, nv) group by session_id, u, v"
)
def median_filter_scans(spark, sf_dir):
    rows = _quarters(spark, sf_dir).select("session_id", "u", "v", F.expr("cast(plane + (u * v + session_id) % 3 as int)").alias("label"))
    return raster.median_filter(rows, "label", 3)


@query(f"with {QUARTERS}, mk as (select session_id, u, v from qx where y_mm is null), d as (select distinct session_id, u + du as u, v + dv as v from mk, {DISC}) select session_id, (u - du)::int as u, (v - dv)::int as v from d, {DISC} group by 1, 2, 3 having count(*) = (select count(*) from {DISC})")
def close_scans(spark, sf_dir):
    return raster.close(_quarters(spark, sf_dir).filter("y_mm is null"), raster.disc(4))


#: Three layers of tint over a base colour.
LAYERS = "ly as (select session_id, u, v, 0 as layer, plane * 60 as r, 10 as g, 20 as b, 0.5::double as alpha from px where u < 70 union all select session_id, u, v, 1, 200, plane * 30, 40, 0.25::double from px where v >= 30 union all select session_id, u, v, 2, 5, 250, plane * 20, 0.75::double from px where (u + v) % 3 = 0)"
OVER = "case when (u + v) % 3 = 0 then 0.75 else 0 end"


@query(
    f"""with {PIXELS}, b0 as (select session_id, u, v, plane, (u * 2)::double as r, v::double as g, ((u + v) % 256)::double as b from px),
b1 as (select *, case when u < 70 then 0.5 else 0 end::double as k, (plane * 60)::double as x, 10::double as y, 20::double as z from b0), c1 as (select session_id, u, v, plane, r * (1 - k) + x * k as r, g * (1 - k) + y * k as g, b * (1 - k) + z * k as b from b1),
b2 as (select *, case when v >= 30 then 0.25 else 0 end::double as k, 200::double as x, (plane * 30)::double as y, 40::double as z from c1), c2 as (select session_id, u, v, plane, r * (1 - k) + x * k as r, g * (1 - k) + y * k as g, b * (1 - k) + z * k as b from b2),
b3 as (select *, ({OVER})::double as k, 5::double as x, 250::double as y, (plane * 20)::double as z from c2)
select session_id, u, v, floor(r * (1 - k) + x * k + 0.5)::int as r, floor(g * (1 - k) + y * k + 0.5)::int as g, floor(b * (1 - k) + z * k + 0.5)::int as b from b3"""
)
def overlay_blend(spark, sf_dir):
    px = pixels(spark, sf_dir).select("session_id", "u", "v", "plane")
    base = px.selectExpr("session_id", "u", "v", "u * 2 r", "v g", "(u + v) % 256 b")
    made = [("u < 70", 0, "plane * 60, 10, 20", 0.5), ("v >= 30", 1, "200, plane * 30, 40", 0.25), ("(u + v) % 3 = 0", 2, "5, 250, plane * 20", 0.75)]
    layers = [px.filter(c).selectExpr("session_id", "u", "v", f"{k} layer", *(f"{x} {n}" for x, n in zip(rgb.split(", "), "rgb")), f"{a}D alpha") for c, k, rgb, a in made]
    return render.overlay(base, layers[0].unionByName(layers[1]).unionByName(layers[2]))


@query(f"with {PIXELS}, lb as (select session_id, u, v, case when y_mm is null then -1 else plane end as label from px), rm as (select session_id, u, v from px where u between 10 and 79), ins as (select * from lb join rm using (session_id, u, v) where label >= 0), e as (select * from ins union all select session_id, u, v, -1 from ins) select session_id, label::int as label, count(*) as n, round(avg(u), 9) as mean_u, round(avg(v), 9) as mean_v, round(100.0::double * count(*) / any_value(t.total), 9) as percent from e join (select session_id, count(*) as total from rm group by session_id) t using (session_id) group by session_id, label")
def region_coverage(spark, sf_dir):
    px = pixels(spark, sf_dir)
    labels = px.select("session_id", "u", "v", F.expr("case when y_mm is null then -1 else plane end").alias("label"))
    return render.coverage(labels, px.filter("u between 10 and 79")).withColumns({c: F.round(c, 9) for c in ("mean_u", "mean_v", "percent")})


PAIR = f"{ASSIGN}, pt as (select session_id, coalesce(label, -1) as pred, plane as truth from assigned)"
IOU = PAIR + ", cm as (select session_id, pred, truth, count(*) as n from pt where pred >= 0 and truth >= 0 group by all)"


def _pairs(spark, sf_dir):
    return _assigned(spark, sf_dir).select("session_id", F.coalesce("label", F.lit(-1)).alias("pred"), F.col("plane").alias("truth"))


@query(f"with {IOU} select * from cm")
def confusion(spark, sf_dir):
    return scoring.confusion(_pairs(spark, sf_dir))


@query(f"with {IOU} select session_id, pred, truth, n, round(n / (sum(n) over (partition by session_id, pred) + sum(n) over (partition by session_id, truth) - n), 6) as iou from cm")
def iou(spark, sf_dir):
    return scoring.iou(scoring.confusion(_pairs(spark, sf_dir))).withColumn("iou", F.round("iou", 6))


@query("select distinct user_id % 50 as session_id, (user_id % 17)::int as label from events e where not exists (select 1 from orders o where o.o_custkey % 50 = e.user_id % 50 and o.o_custkey % 17 = e.user_id % 17)")
def unmatched(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id % 50 session_id", "cast(user_id % 17 as int) label")
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey % 50 session_id", "cast(o_custkey % 17 as int) label").distinct()
    return scoring.unmatched(a, b, "label")


@query()
def hungarian_score(spark, sf_dir):
    return scoring.score(_pairs(spark, sf_dir))


@query(f"with {PIXELS}, a as (select session_id, u, v from px where plane < 2), b as (select session_id, u, v from px where y_mm is not null) select 'and' as op, * from (select * from a intersect select * from b) union all select 'minus', * from (select * from a except select * from b) union all select 'or', * from (select * from a union select * from b)")
def mask_algebra(spark, sf_dir):
    px = pixels(spark, sf_dir)
    a, b = (px.filter(c).select("session_id", "u", "v") for c in ("plane < 2", "y_mm is not null"))
    ops = {"and": a.intersect(b), "minus": a.join(b, ["session_id", "u", "v"], "left_anti"), "or": a.unionByName(b).distinct()}
    parts = [rows.select(F.lit(name).alias("op"), "session_id", "u", "v") for name, rows in ops.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _boxes(spark, sf_dir):
    """Right-angled boxes in whole pixels, one per part."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey as int) k", "cast(p_partkey % 90 as int) a", "cast((p_partkey * 7) % 80 as int) b", "cast(p_size % 9 + 1 as int) w")
    corner = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    return rows.select("k", F.array(corner(a, b), corner(a + w, b), corner(a + w, b + w), corner(a, b + w)).alias("poly"))


FILLED = "bb as (select p_partkey::int as k, (p_partkey % 90)::int as a, ((p_partkey * 7) % 80)::int as b, (p_size % 9 + 1)::int as w from part), fl as (select k, (a + i)::int as u, (b + j)::int as v from bb, unnest(range(0, w + 1)) x(i), unnest(range(0, w + 1)) y(j))"


@query(f"with {FILLED} select k, u, v from fl")
def polygon_fill(spark, sf_dir):
    return raster.fill_polygons(_boxes(spark, sf_dir)).select("k", "u", "v")


@query(f"with {FILLED} select u, v, max(k) as k from fl group by u, v")
def overlay_last_wins(spark, sf_dir):
    return raster.last_wins(raster.fill_polygons(_boxes(spark, sf_dir)), "k")


@query(
    """with r as (select (p_partkey % 20)::bigint as session_id, p_partkey as id, p_partkey % 3 as cluster, p_size as y, (p_partkey % 90)::int as u0, ((p_partkey * 7) % 80)::int as v0,
  (p_partkey % 90 + p_size % 9 + 10)::int as u1, ((p_partkey * 7) % 80 + p_size % 9 + 10)::int as v1 from part)
select * from (select a.session_id, a.id as a, b.id as b, greatest(a.u0, b.u0) as u0, greatest(a.v0, b.v0) as v0, least(a.u1, b.u1) as u1, least(a.v1, b.v1) as v1
  from r a join r b on a.session_id = b.session_id and a.cluster <> b.cluster and (a.y < b.y or (a.y = b.y and a.id < b.id))) where u1 - u0 >= 8 and v1 - v0 >= 8"""
)
def region_pairs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "cast(p_partkey % 20 as bigint) session_id", "p_partkey id", "p_partkey % 3 cluster", "p_size y", "cast(p_partkey % 90 as int) u0", "cast((p_partkey * 7) % 80 as int) v0",
        "cast(p_partkey % 90 + p_size % 9 + 10 as int) u1", "cast((p_partkey * 7) % 80 + p_size % 9 + 10 as int) v1",
    )
    return raster.region_pairs(rows)


@query(f"with {PIXELS}, p as (select session_id as a, session_id + 1 as b, plane = 0 as x, u % 3 = 0 as y from px) select a, b, round(avg((x and not y)::int), 6) as only_a, round(avg((y and not x)::int), 6) as only_b, round(avg((x or y)::int), 6) as either from p group by a, b")
def fill_fractions(spark, sf_dir):
    rows = pixels(spark, sf_dir).selectExpr("session_id a", "session_id + 1 b", "plane = 0 in_a", "u % 3 = 0 in_b")
    return raster.fractions(rows)


@query("select row_number() over (order by mean desc, name)::int as rank, name, mean from (select p_brand as name, round(avg(p_retailprice), 4) as mean from part group by p_brand) order by mean desc, name limit 10")
def leaderboard(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("p_retailprice"), 4).alias("mean"))
    return scoring.leaderboard(rows, "mean", "name", 10).select("rank", "name", "mean")


TINTS = ["#ff7043", "#9c27b0", "#ffeb3b", "#03a9f4", "#e91e63", "#cddc39", "#3f51b5", "#ff9800", "#009688", "#f44336"]


@query(
    f"""with {PIXELS}, t as (select *, {TINTS}[(u % 10) + 1] as tint, (y_mm - 2500) / 50.0 as raw from px), d as (select *, least(greatest(raw, -1), 1) as dev, ('0x' || substr(tint, 2, 2))::int as base from t)
select session_id, u, v, tint, base as red, trunc(base * least(greatest(0.7 + 0.3 * dev, 0.35), 1) + (255 - base * least(greatest(0.7 + 0.3 * dev, 0.35), 1)) * greatest(dev, 0) / 2)::int as shade, case when y_mm is null then 0 else 140 end as alpha,
  case when y_mm is null then '—' else case when y_mm >= 2500 then '+' else '−' end || abs(y_mm - 2500) || ' mm' end as tag from d"""
)
def deviation_shading(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("tint", text.tint(F.col("u"), TINTS))
    y = F.col("y_mm").cast("double")
    # one base channel per pixel: shade() takes a literal, so the red of the tint goes in as a column
    red = text.hex_channel(F.col("tint"), 0)
    value, alpha = text.shade(y, F.lit(2500.0), 50.0, red, F.col("y_mm").isNotNull())
    return px.select("session_id", "u", "v", "tint", red.alias("red"), value.alias("shade"), alpha.alias("alpha"), text.height_tag((F.col("y_mm") - 2500) / 1000.0).alias("tag"))


@query("select p_partkey as id, case when p_partkey % 3 = 0 then p_size::bigint end as i, case when p_partkey % 3 = 1 then p_size + 0.5::double end as f, case when p_partkey % 3 = 2 then p_type end as s from part")
def typed_values(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    word = F.expr("case p_partkey % 3 when 0 then cast(p_size as string) when 1 then concat(cast(p_size as string), '.5') else p_type end")
    return rows.select(F.col("p_partkey").alias("id"), text.typed(word).alias("t")).select("id", "t.*")


def _plan(spark, sf_dir):
    """A plan per nation: its suppliers' rooms as regions, the first as main."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("cast(s_nationkey as bigint) session_id", "s_suppkey", "s_name", "cast(s_suppkey % 100 as double) / 64 mean_y")
    poly = geo.polygon(ROOM)
    kind = F.when(F.col("s_suppkey") % 10 == 0, F.lit("main")).otherwise(F.lit("region"))
    rows = rows.select("session_id", kind.alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("").alias("notes"), poly.alias("polygon"), "mean_y")
    main = rows.filter("kind = 'main'").groupBy("session_id").agg(F.min("id").alias("id"))
    return rows.filter("kind = 'region'").unionByName(rows.join(main, ["session_id", "id"], "left_semi"))


PLAN = "pr as (select s_nationkey::bigint as session_id, s_suppkey as id, s_name as label, (s_suppkey % 100)::double / 64 as mean_y, s_suppkey % 10 = 0 as is_main from supplier), pm as (select session_id, min(id) as id from pr where is_main group by session_id), pl as (select session_id, 'region' as kind, id, label, mean_y from pr where not is_main union all select session_id, 'main', id, label, mean_y from pr semi join pm using (session_id, id))"


@query(f"with {PLAN} select p.session_id, p.kind, p.id, p.label, case when p.kind = 'region' then p.mean_y - m.mean_y end as relative_y, case when p.kind = 'main' then '0 mm' when m.mean_y is null then '—' else case when p.mean_y >= m.mean_y then '+' else '−' end || round_even(abs(p.mean_y - m.mean_y) * 1000, 0)::bigint || ' mm' end as tag from pl p left join pl m on m.session_id = p.session_id and m.kind = 'main'")
def plan_relative(spark, sf_dir):
    return documents.with_relative(_plan(spark, sf_dir)).select("session_id", "kind", "id", "label", "relative_y", "tag")


@query(f"with {PLAN}, k as (select session_id, kind, id, case when kind = 'region' and id % 3 = 1 then 'renamed' else label end as label from pl where not (kind = 'region' and id % 4 = 2)), x as (select session_id, max(id) filter (where kind = 'region') as last from k group by session_id) select * from k union all select n_nationkey::bigint, 'region', coalesce(x.last, -1) + 1, 'Ceiling Region (' || (coalesce(x.last, -1) + 3) || ')' from nation left join x on x.session_id = n_nationkey")
def plan_edits(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    regions = plan.filter("kind = 'region'")
    changes = regions.filter("id % 3 = 1").select("session_id", "id", F.lit("renamed").alias("label"), F.lit(None).cast("string").alias("notes"), F.lit(None).cast(plan.schema["polygon"].dataType).alias("polygon"))
    plan = documents.delete_regions(documents.update_regions(plan, changes), regions.filter("id % 4 = 2"))
    new = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("session_id"), F.lit(None).cast("string").alias("label"), geo.polygon(ROOM).alias("polygon"), F.lit(1.5).alias("mean_y"))
    return documents.add_regions(plan, new).select("session_id", "kind", "id", "label")


@query(f"with {PLAN} select session_id, kind, id, case when kind = 'main' and session_id % 2 = 0 then 'note ' || session_id else '' end as notes from pl")
def main_notes(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    notes = plan.filter("kind = 'main' and session_id % 2 = 0").select("session_id", F.concat(F.lit("note "), F.col("session_id").cast("string")).alias("notes"))
    return documents.set_main_notes(plan, notes).select("session_id", "kind", "id", "notes")


@query(
    f"""with {POLY}, rv as (select id, x, z, i, a[1]::double as ax, a[2]::double as az, b[1]::double as bx, b[2]::double as bz from cs, (select unnest(range(0, 4))::int as i, unnest({[list(p) for p in ROOM]}) as a, unnest({[list(p) for p in ROOM[1:] + ROOM[:1]]}) as b)),
sh as (select id, x, z, 'ell' as name, -1 as turn, 0.8::double as bias, i, ax, az, bx, bz from vx union all select id, x, z, 'room', 0, 1::double, i, ax, az, bx, bz from rv),
nr as (select id, arg_min(name, (d, turn, i)) as name, arg_min(i, (d, turn, i)) as vertex from (select *, sqrt((ax - x) * (ax - x) + (az - z) * (az - z)) * bias as d from sh) where d < 0.7 group by id),
ar as (select id, name, turn, abs(sum(ax * bz - bx * az)) / 2 as area, sum(case when (az > z) <> (bz > z) and x < (bx - ax) * (z - az) / case when bz = az then 1 else bz - az end + ax then 1 else 0 end) % 2 = 1 as inside from sh group by id, name, turn),
ir as (select id, arg_min(name, (area, turn)) as name from ar where inside group by id)
select id, coalesce(nr.name, ir.name) as name, nr.vertex from nr full join ir using (id)"""
)
def hit_test(spark, sf_dir):
    rows = _polygons(spark, sf_dir)
    shapes = rows.select("id", F.lit("ell").alias("name"), F.lit(1).alias("position"), F.col("poly").alias("polygon"))
    shapes = shapes.unionByName(rows.select("id", F.lit("room").alias("name"), F.lit(0).alias("position"), geo.polygon(ROOM).alias("polygon")))
    return documents.hit_test(rows.select("id", "x", "z", F.lit("ell").alias("selected")), shapes, 0.7, "id")


#: An L for each nation as its room, moved by the nation.
NATION_ROOM = f"vn as (select n_nationkey::bigint as session_id, i, a[1]::double + n_nationkey % 7 as ax, a[2]::double as az, b[1]::double + n_nationkey % 7 as bx, b[2]::double as bz from nation, (select unnest(range(0, 6))::int as i, unnest({[list(p) for p in ELL]}) as a, unnest({[list(p) for p in ELL[1:] + ELL[:1]]}) as b))"


def _drawn(spark, sf_dir):
    """The plans of ``_plan``, those of even nations with notes, and rooms for all nations but every fifth."""
    plan = _plan(spark, sf_dir)
    notes = plan.filter("kind = 'main' and session_id % 2 = 0").select("session_id", F.concat(F.lit("note "), F.col("session_id").cast("string")).alias("notes"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("session_id"))
    moved = F.transform(geo.polygon(ELL), lambda p: F.struct((p["x"] + F.col("session_id") % 7).alias("x"), p["z"].alias("z")))
    rooms = nations.filter("session_id % 5 <> 4").select("session_id", F.lit(None).cast("string").alias("label"), moved.alias("polygon"), F.lit(None).cast("double").alias("mean_y"))
    return documents.set_single(documents.set_main_notes(plan, notes), "room", rooms)


@query(
    f"""with {PLAN}, {NATION_ROOM}, c as (select *, avg(ax) over (partition by session_id) as cx, avg(az) over (partition by session_id) as cz, sqrt((bx - ax) ^ 2 + (bz - az) ^ 2) as len from vn),
n as (select *, -(bz - az) / len as nx, (bx - ax) / len as nz, (ax + bx) / 2 as mx, (az + bz) / 2 as mz, degrees(atan2(bz - az, bx - ax)) as turn from c where len >= 0.001),
s as (select *, case when nx * (mx - cx) + nz * (mz - cz) < 0 then -1 else 1 end as side from n),
al as (select session_id, 'dimension' as layer, i::bigint as item, round_even(len * 1000, 0)::bigint || ' mm' as text, round(mx + side * nx * 0.18, 6) as x, round(mz + side * nz * 0.18, 6) as z, round(case when turn > 90 then turn - 180 when turn < -90 then turn + 180 else turn end, 6) as angle, null as face, '#222' as edge from s
union all select distinct session_id, 'room', null, null, null, null, null, null, '#222' from vn
union all select p.session_id, 'shape', case when p.kind = 'region' then p.id end, p.label || chr(10) || case when p.kind = 'main' then '0 mm' when m.mean_y is null then '—' else case when p.mean_y >= m.mean_y then '+' else '−' end || round_even(abs(p.mean_y - m.mean_y) * 1000, 0)::bigint || ' mm' end || case when p.kind = 'main' and p.session_id % 2 = 0 then chr(10) || 'note ' || p.session_id else '' end,
  {round(sum(p[0] for p in ROOM) / len(ROOM), 6)}::double, {round(sum(p[1] for p in ROOM) / len(ROOM), 6)}::double, 0::double, case when p.kind = 'main' then '#80cbc4' else {TINTS}[p.id % 10 + 1] end, case when p.kind = 'main' then '#00897b' else '#444' end from pl p left join pl m on m.session_id = p.session_id and m.kind = 'main')
select * from al where session_id % 5 <> 4 and session_id in (select n_nationkey from nation)"""
)
def drawing_marks(spark, sf_dir):
    rows = drawing.marks(_drawn(spark, sf_dir)).drop("polygon")
    return rows.withColumns({c: F.round(c, 6) for c in ("x", "z", "angle")})


@query(f"with {NATION_ROOM}, b as (select session_id, min(ax) - 0.5 as min_x, max(ax) + 0.5 as max_x, min(az) - 0.5 as min_z, max(az) + 0.5 as max_z from vn where session_id % 5 <> 4 group by session_id) select *, 'Reflected Ceiling Plan — session ' || session_id as title, 11::double as page_width, round(greatest(8.5, 11 / ((max_x - min_x) / (max_z - min_z))), 6) as page_height from b")
def drawing_pages(spark, sf_dir):
    return drawing.pages(_drawn(spark, sf_dir)).withColumn("page_height", F.round("page_height", 6))


@query()
def plan_json(spark, sf_dir):
    return documents.to_json(_plan(spark, sf_dir))


@query()
def height_clusters(spark, sf_dir):
    down = mesh.downward(_geometry(spark, sf_dir)).select((F.col("fid") % 8).alias("session_id"), F.round(F.col("cy") * 1000).cast("int").alias("y"), "area")
    return heights.clusters(down, "y", "area", WIDTH, 50, SEPARATION, 0.5)


@query()
def auto_detect(spark, sf_dir):
    return segment.auto_detect(pixels(spark, sf_dir), "y_mm", WIDTH, SEPARATION, 7, 20)


@query(f"with {PIXELS}, m as (select session_id, u, v, case when u < 60 then 0 end as r0, case when u >= 50 and v % 10 < 7 then 1 end as r1 from px where y_mm is not null), w as (select session_id, u, v, coalesce(r1, r0) as region from m where coalesce(r1, r0) is not null) select p.session_id, p.u, p.v, (select arg_min(s.region, ((s.u - p.u) ^ 2 + (s.v - p.v) ^ 2, s.v, s.u)) from w s where s.session_id = p.session_id and abs(s.u - p.u) <= 15 and abs(s.v - p.v) <= 15)::int as region from px p")
def snap(spark, sf_dir):
    px = pixels(spark, sf_dir)
    seen = px.filter("y_mm is not null").select("session_id", "u", "v")
    masks = seen.filter("u < 60").withColumn("region", F.lit(0)).unionByName(seen.filter("u >= 50 and v % 10 < 7").withColumn("region", F.lit(1)))
    return segment.snap(masks, px)


def _rooms(spark, sf_dir):
    """Quarters of scans in metres, whole grids as rooms, and their frames: 16 pixels a metre, the corner at 8 m."""
    rows = _quarters(spark, sf_dir).withColumns({"y": F.col("y_mm") / 1000.0, "in_room": F.lit(True)})
    return rows, rows.select("session_id").distinct().withColumns({"max_x": F.lit(8.0), "max_z": F.lit(8.0)})


#: Statistics of a plan's polygons from rows ``sn`` (session_id, region, y), the main being region 0.
PLAN_STATS = """ss as (select session_id, region, round(avg(y), 9) as mean_y, round(stddev_pop(y), 6) as std_y, count(y) as n_valid, count(*) as n_total from sn group by all)
select s.session_id, case when s.region = 0 then 'main' else 'region' end as kind, case when s.region > 0 then s.region - 1 end as id, s.mean_y, s.std_y, s.n_valid, s.n_total, case when s.region > 0 then round(s.mean_y - m.mean_y, 9) end as relative_y from ss s join ss m on m.session_id = s.session_id and m.region = 0"""


def _plan_stats(rows):
    return rows.select("session_id", "kind", "id", "mean_y", F.round("std_y", 6).alias("std_y"), "n_valid", "n_total", F.round("relative_y", 9).alias("relative_y"))


@query(
    f"""with {QUARTERS}, fq as materialized (select p.session_id, p.u, p.v, p.y_mm, case when p.y_mm is not null then p.plane else (select arg_min(s.plane, ((s.u - p.u) ^ 2 + (s.v - p.v) ^ 2, s.v, s.u)) from qx s where s.session_id = p.session_id and s.y_mm is not null) end::int as label from qx p),
bq as (select session_id, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from qx group by session_id),
ng as (select session_id, u, v, least(greatest(u + du, u0), u1) as nu, least(greatest(v + dv, v0), v1) as nv from qx join bq using (session_id), (select unnest([-1, 0, 1]) as du), (select unnest([-1, 0, 1]) as dv)),
md as (select g.session_id, g.u, g.v, quantile_disc(f.label, 0.5) as label from ng g join fq f on f.session_id = g.session_id and f.u = g.nu and f.v = g.nv group by all),
ar as (select session_id, label, count(*) as n, min(v * 1048576 + u) as first from md group by all),
rk as (select *, row_number() over (partition by session_id order by n desc, first) = 1 as main from ar),
ix as (select *, case when main then 0 else row_number() over (partition by session_id, main order by label) end as region from rk),
sn as (select session_id, region, case when abs(y_mm / 1000.0 - (2.4 + 0.15 * label)) <= 0.06 then y_mm / 1000.0 end as y from md join ix using (session_id, label) join fq using (session_id, u, v)), {PLAN_STATS}"""
)
def auto_detect_plan(spark, sf_dir):
    rows, grid = _rooms(spark, sf_dir)
    return _plan_stats(compose.detect(rows, grid, 16.0, least_edge=0.25, least_seen=100))


@query(
    f"""with {QUARTERS}, sn as (select session_id, case when u - (15 + session_id % 5) <= (30 + session_id % 7) - u then 0 else 1 end as region, y_mm / 1000.0 as y from qx), {PLAN_STATS}"""
)
def snap_plan(spark, sf_dir):
    """A main from the left and a region from the right meet in the middle of the gap between them."""
    rows, grid = _rooms(spark, sf_dir)
    edge = rows.groupBy("session_id").agg(F.max("v").alias("v1"))
    point = lambda u, v: F.struct((8.0 - u / 16).alias("x"), (8.0 - v / 16).alias("z"))
    box = lambda a, b: F.array(point(a, F.lit(0)), point(b, F.lit(0)), point(b, F.col("v1")), point(a, F.col("v1")))
    main = edge.select("session_id", F.lit("main").alias("kind"), F.lit(None).cast("long").alias("id"), F.lit("m").alias("label"), F.lit("").alias("notes"), box(F.lit(0), 15 + F.col("session_id") % 5).alias("polygon"))
    region = edge.select("session_id", F.lit("region").alias("kind"), F.lit(0).cast("long").alias("id"), F.lit("r").alias("label"), F.lit("").alias("notes"), box(30 + F.col("session_id") % 7, F.lit(49)).alias("polygon"))
    return _plan_stats(compose.snap(main.unionByName(region), rows, grid, 16.0))


@query()
def contour(spark, sf_dir):
    labels = pixels(spark, sf_dir).select("session_id", "u", "v", F.col("plane").alias("label"))
    return outline.of_labels(labels, 1.0)


#: Masks of planes with their holes: pixels, sides and the Euler number from quads of pixels.
FACTS = f"""with {QUARTERS}, mk as (select session_id, plane as label, u, v from qx where y_mm is not null),
qd as (select session_id, label, u - du as u, v - dv as v, bit_or((1 << (2 * dv + du))::int) as q, count(*) as n from mk, (select unnest([0, 1]) as du), (select unnest([0, 1]) as dv) group by all),
eu as (select session_id, label, (count(*) filter (where n = 1) - count(*) filter (where n = 3) - 2 * count(*) filter (where q in (6, 9))) // 4 as euler from (select session_id, label, u, v, bit_or(q) as q, sum(n) as n from qd group by all) group by all),
sd as (select session_id, label, count(*) as pixels, sum(4 - (select count(*) from mk o where o.session_id = m.session_id and o.label = m.label and abs(o.u - m.u) + abs(o.v - m.v) = 1))::bigint as sides from mk m group by all)
select session_id, label, pixels, sides, euler::bigint as euler from sd join eu using (session_id, label)"""


@query(FACTS)
def outline_facts(spark, sf_dir):
    """What the rings of each plane's seen pixels add up to."""
    masks = _quarters(spark, sf_dir).filter("y_mm is not null").select("session_id", F.col("plane").alias("label"), "u", "v")
    sign = F.when(F.col("hole"), -1).otherwise(1)
    found = outline.rings(masks, ["session_id", "label"]).groupBy("session_id", "label")
    return found.agg(F.sum(sign * F.col("pixels")).alias("pixels"), F.sum("sides").alias("sides"), F.sum(sign).alias("euler"))


#: Battens in strips of ten pixels, lattices, checks and slanted battens by scan, with the holes of the heights.
STRIPES = "case session_id % 4 when 0 then u // 3 % 2 when 1 then case when u % 6 < 2 or v % 6 in (3, 4) then 1 else 0 end when 2 then (u // 4 + v // 4) % 2 else (u + v) // 4 % 2 end"
STRIP = "case session_id % 4 when 0 then v // 10 else 0 end"
COMPOSITE = f"""with {QUARTERS}, pr as (select session_id, ({STRIP})::int as a, u, v, y_mm is not null and s = 0 as in_a, y_mm is not null and s = 1 as in_b, session_id % 3 * 0.125::double as delta_y from (select *, {STRIPES} as s from qx)),
bx as (select session_id, a, min(u) as u0, min(v) as v0, max(u) - min(u) + 1 as w, max(v) - min(v) + 1 as h, avg((in_a and not in_b)::int) as only_a, avg((in_b and not in_a)::int) as only_b, avg((in_a or in_b)::int) as either, count(*) filter (where in_a <> in_b) as n, max(delta_y) as delta_y from pr group by session_id, a),
ok as materialized (select *, (session_id * 10 + a) * 1000000 as box from bx where w >= 8 and h >= 8 and n >= 64 and abs(delta_y) <= 0.4 and only_a >= 0.1 and only_b >= 0.1 and either >= 0.45),
fd as materialized (select box, u, v, box + 1000 * v + u as spot, in_b::int - in_a::int as f, in_b::int - in_a::int - avg(in_b::int - in_a::int) over (partition by box) as x from pr join ok using (session_id, a)),
en as (select box, sum(x * x) as e from fd group by box),
mw as (select du, dv from (select unnest(range(-16, 17))::int as du), (select unnest(range(0, 17))::int as dv) where du * du + dv * dv <= 256 and (dv > 0 or du > 0)),
mx as materialized (select box, spot + 1000 * dv + du as spot, du, dv, x from fd, mw),
hf as materialized (select b.box, du, dv, round(sum(a.x * b.x) / any_value(e), 9) as c from mx a join fd b on a.spot = b.spot join en on en.box = b.box group by b.box, du, dv),
cg as (select box, du, dv, c from hf union all select box, -du, -dv, c from hf),
pk as materialized (select box, dv, du, c, sqrt((du * du + dv * dv)::double) as r from (select *, row_number() over (partition by box order by c desc, dv, du) as k from cg where du * du + dv * dv between 9 and 225) where k = 1 and c >= 0.35),
pt as (select box, round_even(-t * dv / r, 0)::int as du, round_even(t * du / r, 0)::int as dv from pk, (select unnest(range(3, 16)) as t)),
ac as (select box, max(c) as c from pt join cg using (box, du, dv) group by box),
ln as (select box, t, (u0 + w // 2 + round_even(t * du / r, 0))::int as u, (v0 + h // 2 + round_even(t * dv / r, 0))::int as v from pk join ok using (box), (select unnest(range(-71, 72)) as t) where abs(t) <= floor(sqrt((w * w + h * h)::double))),
tn as (select box, count(*) filter (where f <> before) as turns from (select box, f, lag(f) over (partition by box order by t) as before from ln join fd using (box, u, v) where f <> 0) group by box)
select session_id, a, a + 1 as b, case when greatest(coalesce(ac.c, 0), 0) >= 0.6 * pk.c then 'grid' else 'linear' end as kind, round(r / 25, 6) as pitch_m, round(degrees(atan2(dv::double, du::double)), 6) as angle, round(pk.c, 6) as strength, round(greatest(coalesce(ac.c, 0), 0), 6) as across, delta_y, round(only_a, 6) as only_a, round(only_b, 6) as only_b, turns::bigint as turns
from pk join ok using (box) join tn using (box) left join ac using (box) where turns >= 4"""


@query(COMPOSITE)
def periodic_composite(spark, sf_dir):
    rows = _quarters(spark, sf_dir).withColumn("s", F.expr(STRIPES.replace("//", "div"))).withColumn("a", F.expr(f"cast({STRIP.replace('//', 'div')} as int)"))
    seen = F.col("y_mm").isNotNull()
    rows = rows.select("session_id", "a", (F.col("a") + 1).alias("b"), "u", "v", (seen & (F.col("s") == 0)).alias("in_a"), (seen & (F.col("s") == 1)).alias("in_b"), (F.col("session_id") % 3 * F.lit(0.125)).alias("delta_y"))
    found = periodic.composites(rows, 25.0)
    return found.withColumns({c: F.round(c, 6) for c in ("pitch_m", "angle", "strength", "across", "only_a", "only_b")})


def _segmentation(name: str) -> Query:
    def run(spark, sf_dir):
        return segment.segment(scans(spark, sf_dir), name, 20.0)

    return run


for _name in segment.kernels.SEG:
    QUERIES[f"seg_{_name}"] = _segmentation(_name)


@query()
def tiled_felzenszwalb(spark, sf_dir):
    return contract.felzenszwalb(scans(spark, sf_dir), 20.0, merge=0.02, tile=48)


@query()
def tiled_felzenszwalb_image(spark, sf_dir):
    return contract.felzenszwalb_image(scans(spark, sf_dir), 20.0, tile=48)


@query()
def tiled_felzenszwalb_combined(spark, sf_dir):
    return contract.felzenszwalb_combined(scans(spark, sf_dir), 20.0, tile=48)


#: The reference's grid of name, algorithm and arguments.
EXPERIMENTS: list[tuple[str, str, dict]] = [
    ("histogram", "histogram", {}),
    ("felzenszwalb_s100", "felzenszwalb", {"scale": 100}),
    ("felzenszwalb_s200", "felzenszwalb", {"scale": 200}),
    ("felzenszwalb_s400", "felzenszwalb", {"scale": 400}),
    ("felzenszwalb_s800", "felzenszwalb", {"scale": 800}),
    ("felzenszwalb_s1500", "felzenszwalb", {"scale": 1500}),
    ("felzenszwalb_s400_sigma0", "felzenszwalb", {"scale": 400, "sigma": 0.0}),
    ("region_growing_1cm", "region_growing", {"threshold_m": 0.01}),
    ("region_growing_2cm", "region_growing", {"threshold_m": 0.02}),
    ("region_growing_3cm", "region_growing", {"threshold_m": 0.03}),
    ("region_growing_5cm", "region_growing", {"threshold_m": 0.05}),
    ("wall_constrained_010", "wall_constrained", {"min_cell_px_m2": 0.1}),
    ("wall_constrained_030", "wall_constrained", {"min_cell_px_m2": 0.3}),
    ("wall_constrained_060", "wall_constrained", {"min_cell_px_m2": 0.6}),
    ("felzenszwalb_s150", "felzenszwalb", {"scale": 150}),
    ("felzenszwalb_s175", "felzenszwalb", {"scale": 175}),
    ("felzenszwalb_s225", "felzenszwalb", {"scale": 225}),
    ("felzenszwalb_s250", "felzenszwalb", {"scale": 250}),
    ("felz_merged_s200_2cm", "felzenszwalb_merged", {"scale": 200, "merge_threshold_m": 0.02}),
    ("felz_merged_s200_3cm", "felzenszwalb_merged", {"scale": 200, "merge_threshold_m": 0.03}),
    ("felz_merged_s200_5cm", "felzenszwalb_merged", {"scale": 200, "merge_threshold_m": 0.05}),
    ("felz_merged_s400_3cm", "felzenszwalb_merged", {"scale": 400, "merge_threshold_m": 0.03}),
    ("watershed_default", "watershed_multi", {}),
    ("watershed_high_wall", "watershed_multi", {"wall_weight": 4.0}),
    ("watershed_no_texture", "watershed_multi", {"texture_weight": 0.0}),
    ("watershed_high_texture", "watershed_multi", {"texture_weight": 1.5}),
    ("region_growing_tex_3cm", "region_growing_texture", {"threshold_m": 0.03}),
    ("slic_merge_n200_2cm", "slic_merge", {"n_segments": 200, "merge_threshold_m": 0.02}),
    ("slic_merge_n500_2cm", "slic_merge", {"n_segments": 500, "merge_threshold_m": 0.02}),
    ("slic_merge_n1000_3cm", "slic_merge", {"n_segments": 1000, "merge_threshold_m": 0.03}),
    ("felz_image_s200_3cm", "felzenszwalb_image", {"scale": 200, "merge_threshold_m": 0.03}),
    ("felz_image_s400_3cm", "felzenszwalb_image", {"scale": 400, "merge_threshold_m": 0.03}),
    ("felz_image_s800_3cm", "felzenszwalb_image", {"scale": 800, "merge_threshold_m": 0.03}),
    ("felz_image_only_s400", "felzenszwalb_image_only", {"scale": 400}),
    ("felz_image_only_s800", "felzenszwalb_image_only", {"scale": 800}),
    ("felz_combined_s200", "felzenszwalb_combined", {"scale": 200}),
    ("felz_combined_s200_h2", "felzenszwalb_combined", {"scale": 200, "intensity_weight": 0.6}),
]


@query()
def experiment_sweep(spark, sf_dir):
    """Scores of the reference's configurations on every scan, best first; one that labels nothing scores 0."""
    rows = scans(spark, sf_dir)
    counts = segment.sweep_confusion(rows, EXPERIMENTS, 20.0, "plane")
    scored = scoring.score_matrix(counts.withColumn("run", F.concat_ws("|", "session_id", "name")), "run", "session_id")
    runs = spark.createDataFrame([(k, name, algorithm) for k, (name, algorithm, _) in enumerate(EXPERIMENTS)], "position int, name string, algorithm string")
    every = rows.select("session_id").distinct().crossJoin(F.broadcast(runs)).withColumn("run", F.concat_ws("|", "session_id", "name"))
    whole = every.join(scored, "run", "left").fillna(0)
    best = Window.partitionBy("session_id").orderBy(F.desc("mean_iou"), "position")
    return whole.withColumn("rank", F.row_number().over(best)).drop("position").orderBy("session_id", "rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes found by histogram peaks, with their statistics and heights over the largest."""
    rows = _assigned(spark, sf_dir).filter("label is not null")
    found = heights.stats(rows, ["session_id", "label"], "y_mm")
    return heights.relative(found, found.filter("label = 0"))


QUERIES["planes"] = flagship
SQL["planes"] = f"with {ASSIGN}, st as (select session_id, label, {STATS} from assigned where label is not null group by all) select s.*, s.mean_y - m.mean_y as relative_y from st s left join st m on m.session_id = s.session_id and m.label = 0"

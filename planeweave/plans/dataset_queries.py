"""Dataset assembly, file ingest, incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.numeric import nan_to_null, rnd
from planeweave.operators import datasets as D
from planeweave.plans.registry import NAMES, R1, R2, query, rd
from planeweave.schema import PLANE
from planeweave.session import spread
from planeweave.sources import raster_files as S1
from planeweave.sources import raster_ranges as RR
from planeweave.sources import views
from planeweave.streaming import incremental as ST

_HDR = """hdr AS (SELECT '/s' || o_custkey || '/im' || (l_linenumber * 7 % 13) || '_' || l_partkey || '_' || l_suppkey || '.dcm' AS path, l_linenumber <> 7 AS px, o_orderkey AS sop, o_custkey AS ser,
   CASE WHEN o_custkey % 3 <> 0 THEN floor(o_totalprice / 20000) END AS pos, CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 5 ELSE 9 END END AS t,
   CASE WHEN o_custkey % 5 = 0 THEN 1 + o_orderkey % 3 ELSE 1 END AS frames FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _headers(spark, sf):
    li, o = views.table(spark, sf, "lineitem"), views.table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.expr("concat('/s', o_custkey, '/im', l_linenumber * 7 % 13, '_', l_partkey, '_', l_suppkey, '.dcm')").alias("path"),
        F.expr("l_linenumber <> 7").alias("has_pixels"), F.col("o_orderkey").cast("string").alias("sop_uid"),
        F.col("o_custkey").cast("string").alias("series_uid"), F.lit("").alias("study_uid"), F.lit(None).cast("int").alias("series_number"),
        F.lit(None).cast("string").alias("frame_of_reference"), F.lit(512).alias("rows"), F.lit(512).alias("columns"),
        F.expr("if(o_custkey % 3 <> 0, array(1D, 2D, cast(floor(o_totalprice / 20000) as double)), null)").alias("position"),
        F.expr("array(1D, 0D, 0D, 0D, 1D, 0D)").alias("orientation"), F.col("o_orderkey").alias("instance_number"),
        F.expr("case when o_custkey % 2 = 0 then case o_orderstatus when 'O' then 0 when 'F' then 5 else 9 end end").alias("t"),
        F.lit(None).cast("int").alias("echo"), F.expr("if(o_custkey % 5 = 0, 1 + o_orderkey % 3, 1)").cast("int").alias("frames"))


_SERIES = f"""{_HDR},
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sop ORDER BY regexp_replace(regexp_replace(lower(path), '([0-9]+)', '00000000000000000000\\1', 'g'), '[0-9]*([0-9]{{20}})', '\\1', 'g'), path) AS rk FROM hdr WHERE px) WHERE rk = 1),
gr AS (SELECT ser, count(DISTINCT t) > 1 AS has_t, max(frames) > 1 AS has_f FROM one GROUP BY ALL),
zz AS (SELECT one.*, has_t, has_f, ser || '||512x512|1.0000\\0.0000\\0.0000\\0.0000\\1.0000\\0.0000' AS group_id, CASE WHEN has_t THEN dense_rank() OVER (PARTITION BY ser ORDER BY t) - 1 END AS ti,
   CASE WHEN pos IS NOT NULL THEN dense_rank() OVER (PARTITION BY ser ORDER BY pos) - 1
        WHEN has_t THEN row_number() OVER (PARTITION BY ser, t ORDER BY sop) - 1 ELSE row_number() OVER (PARTITION BY ser ORDER BY sop) - 1 END AS z FROM one JOIN gr USING (ser))"""


@query("d1_assemble_series", f"""WITH {_SERIES}
SELECT group_id, path, CAST(f.i AS INTEGER) AS frame_index, CAST(z AS INTEGER) AS z, CAST(ti AS INTEGER) AS t, CAST(CASE WHEN has_f THEN f.i END AS INTEGER) AS frame
FROM zz JOIN range(3) f(i) ON f.i < frames""")
def d1(spark, sf):
    d = D.assemble_series(_headers(spark, sf))
    return d.select("group_id", "path", "frame_index", *[F.col("coordinates")[a].alias(a) for a in ("z", "t", "frame")])


@query("d1_series_axes", f"""WITH {_SERIES}, ax AS (SELECT group_id, max(z) + 1 AS nz, max(frames) AS nf, max(ti) + 1 AS nt, bool_or(has_f) AS has_f FROM zz GROUP BY ALL)
SELECT group_id, 0 AS position, 'z' AS axis, 'Slice' AS label, CAST(nz AS INTEGER) AS size FROM ax WHERE nz > 1 OR NOT has_f
UNION ALL SELECT group_id, 1, 'frame', 'Frame', CAST(nf AS INTEGER) FROM ax WHERE has_f UNION ALL SELECT group_id, 2, 't', 'Time', CAST(nt AS INTEGER) FROM ax WHERE nt IS NOT NULL""")
def d1_axes(spark, sf):
    return D.series_axes(_headers(spark, sf))


@query("d1_series_axis_values", f"""WITH {_SERIES} SELECT DISTINCT group_id, 't' AS axis, CAST(ti AS INTEGER) AS index, CAST(t AS DOUBLE) AS value FROM zz WHERE ti IS NOT NULL""")
def d1_values(spark, sf):
    return D.series_axis_values(_headers(spark, sf))


_IM = """im AS (SELECT p_partkey AS image_id, ['XYZCT','XYCZT','XYTCZ','XYZTC','XYCTZ','XYT'][p_partkey % 6 + 1] AS ord, ['ZCT','CZT','TCZ','ZTC','CTZ','TZC'][p_partkey % 6 + 1] AS ax,
   1 + p_size % 3 AS size_c, CAST(1 + p_partkey % 4 AS INTEGER) AS nz, 1 + p_size % 2 AS nt, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 1 + p_size % 3 END AS nc FROM part),
sr AS (SELECT *, (CASE WHEN strpos(ax, 'Z') < strpos(ax, 'C') THEN nz ELSE 1 END) * (CASE WHEN strpos(ax, 'T') < strpos(ax, 'C') THEN nt ELSE 1 END) AS sc,
   (CASE WHEN strpos(ax, 'C') < strpos(ax, 'Z') THEN nc ELSE 1 END) * (CASE WHEN strpos(ax, 'T') < strpos(ax, 'Z') THEN nt ELSE 1 END) AS sz,
   (CASE WHEN strpos(ax, 'C') < strpos(ax, 'T') THEN nc ELSE 1 END) * (CASE WHEN strpos(ax, 'Z') < strpos(ax, 'T') THEN nz ELSE 1 END) AS st FROM im)"""


def _images(spark, sf):
    return views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("image_id"),
        F.expr("element_at(array('XYZCT','XYCZT','XYTCZ','XYZTC','XYCTZ','XYT'), cast(p_partkey % 6 as int) + 1)").alias("dimension_order"),
        F.expr("1 + p_size % 3").alias("size_c"), F.expr("cast(1 + p_partkey % 4 as int)").alias("size_z"), F.expr("1 + p_size % 2").alias("size_t"),
        F.expr("if(p_partkey % 5 = 0, array(1 + p_size % 3), array_repeat(1, 1 + p_size % 3))").alias("samples"),
        F.expr("concat('u', p_partkey)").alias("uuid"))


@query("d2_plane_map", f"""WITH {_IM},
rg AS (SELECT image_id, 0 AS o, 0 AS ifd, 0 AS c0, 0 AS z0, 0 AS t0, nc * nz * nt AS n, '' AS fn, NULL AS u FROM sr WHERE image_id % 3 = 0
  UNION ALL SELECT image_id, 0, 3, 0, least(1, nz - 1), 0, 2, 'a.tif', 'u' || image_id FROM sr WHERE image_id % 3 <> 0
  UNION ALL SELECT image_id, 1, 10, nc - 1, 0, nt - 1, 1, 'b.tif', 'other' FROM sr WHERE image_id % 3 <> 0),
ex AS (SELECT sr.*, o, k.i AS k, ifd + k.i AS page, fn, u, c0 * sc + z0 * sz + t0 * st + k.i AS ix FROM rg JOIN sr USING (image_id) JOIN range(64) k(i) ON k.i < n),
co AS (SELECT image_id, o, k, page, fn, (fn = '' OR u = 'u' || image_id) AS loc, CAST((ix // sc) % nc AS INTEGER) AS c, CAST((ix // sz) % nz AS INTEGER) AS z, CAST((ix // st) % nt AS INTEGER) AS t FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, c, z, t ORDER BY o DESC, k DESC) AS r FROM co)
SELECT image_id, c, z, t, CAST(page AS INTEGER) AS page, fn AS file_name, loc AS local FROM rk WHERE r = 1""")
def d2(spark, sf):
    im = _images(spark, sf)
    st = im.withColumn("nc", D.plane_channel_size(F.col("samples"), F.col("size_c")))
    null = F.lit(None).cast("int")
    whole = st.where("image_id % 3 = 0").select(
        "image_id", F.lit(0).alias("ordinal"), null.alias("ifd"), null.alias("first_c"), null.alias("first_z"), null.alias("first_t"),
        null.alias("plane_count"), F.lit("").alias("file_name"), F.lit(None).cast("string").alias("uuid"))
    a = st.where("image_id % 3 <> 0").select(
        "image_id", F.lit(0).alias("ordinal"), F.lit(3).alias("ifd"), F.lit(0).alias("first_c"), F.expr("least(1, size_z - 1)").alias("first_z"),
        F.lit(0).alias("first_t"), F.lit(2).alias("plane_count"), F.lit("a.tif").alias("file_name"), F.col("uuid"))
    b = st.where("image_id % 3 <> 0").select(
        "image_id", F.lit(1).alias("ordinal"), F.lit(10).alias("ifd"), (F.col("nc") - 1).alias("first_c"), F.lit(0).alias("first_z"),
        (F.col("size_t") - 1).alias("first_t"), null.alias("plane_count"), F.lit("b.tif").alias("file_name"), F.lit("other").alias("uuid"))
    return D.plane_map(im, whole.unionByName(a).unionByName(b)).withColumn("page", F.col("page").cast("int"))


@query("d3_resolve_fileset", f"""WITH {NAMES}, fb AS (SELECT regexp_extract(path, '([^/]*)$', 1) AS base, path FROM fn WHERE page_id % 2 = 0)
SELECT page_id AS plane_id, f.path AS resource FROM (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS base FROM fn UNION ALL
  SELECT page_id + 1000000, regexp_extract(path, '([^/]*)$', 1) FROM fn) p JOIN fb f USING (base)""")
def d3(spark, sf):
    n = views.file_names(spark, sf)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    named = n.select(F.col("page_id").alias("plane_id"), F.concat(F.lit("C:\\data\\"), base).alias("file_name"), F.lit("x").alias("self_name"))
    own = n.select((F.col("page_id") + 1000000).alias("plane_id"), F.lit("").alias("file_name"), base.alias("self_name"))
    return D.resolve_fileset(named.unionByName(own), n.where("page_id % 2 = 0")).select("plane_id", "resource")


_ACQ = """ac AS (SELECT s_suppkey AS image_id, s_suppkey % 4 AS lt, s_suppkey % 3 AS lp, s_suppkey % 5 + 1 AS lz FROM supplier),
pr AS (SELECT *, greatest(lt, 1) * greatest(lp, 1) * lz AS prod FROM ac),
fr AS (SELECT *, CASE WHEN image_id % 7 = 0 THEN prod * 2 + 1 ELSE prod * (1 + image_id % 2) END AS frames FROM pr),
ok AS (SELECT *, frames % prod = 0 AS fits, frames // prod AS rest FROM fr),
xf AS (SELECT ok.*, f.i AS frame, fits AND rest > 1 AS extra FROM ok JOIN range(200) f(i) ON f.i < frames),
co AS (SELECT image_id, frame, CASE WHEN fits AND lt > 1 THEN frame // (rest * lz * greatest(lp, 1)) % lt END AS axis_t,
   CASE WHEN fits AND lp > 1 THEN frame // (rest * lz) % lp WHEN extra AND lp <= 1 THEN frame % rest END AS axis_p, CASE WHEN fits AND lz > 1 THEN frame // rest % lz END AS axis_z,
   CASE WHEN extra AND lp > 1 THEN frame % rest END AS axis_s, CASE WHEN NOT fits THEN frame END AS axis_frame FROM xf)"""


def _acquisitions(spark, sf):
    a = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"), F.expr("s_suppkey % 4").alias("lt"),
                                                 F.expr("s_suppkey % 3").alias("lp"), F.expr("s_suppkey % 5 + 1").alias("lz"))
    a = a.withColumn("prod", F.expr("greatest(lt, 1) * greatest(lp, 1) * lz"))
    return a.select("image_id", F.expr("array(struct(1 as type, lt as count), struct(2 as type, lp as count), struct(4 as type, lz as count))").alias("loops"),
                    F.expr("cast(if(image_id % 7 = 0, prod * 2 + 1, prod * (1 + image_id % 2)) as int)").alias("frames"))


@query("d4_loop_frames", f"WITH {_ACQ} SELECT image_id, CAST(frame AS INTEGER) AS frame, axis_t, axis_p, axis_z, axis_s, axis_frame FROM co")
def d4(spark, sf):
    d = D.loop_frames(_acquisitions(spark, sf))
    return d.select("image_id", "frame", *[F.col("coordinates")[a].cast("long").alias(f"axis_{a.lower()}") for a in ("T", "P", "Z", "S", "Frame")])


@query("d5_lookup_planes", f"""WITH {_ACQ}, sz AS (SELECT image_id, max(axis_t) AS t, max(axis_p) AS p, max(axis_z) AS z, max(axis_s) AS s, max(axis_frame) AS f FROM co GROUP BY ALL),
rq AS (SELECT c_custkey AS request_id, c_custkey AS image_id, c_custkey % 7 AS wt, c_custkey % 9 - 2 AS wz, c_custkey % 4 AS wp FROM customer)
SELECT request_id, image_id AS series_id, 'f' || co.frame AS resource FROM rq JOIN sz USING (image_id) JOIN co USING (image_id)
WHERE (sz.t IS NULL OR co.axis_t = greatest(0, least(wt, sz.t))) AND (sz.p IS NULL OR co.axis_p = greatest(0, least(wp, sz.p))) AND (sz.z IS NULL OR co.axis_z = greatest(0, least(wz, sz.z))) AND (sz.s IS NULL OR co.axis_s = 0) AND (sz.f IS NULL OR co.axis_frame = 0)""")
def d5(spark, sf):
    a = _acquisitions(spark, sf)
    axes = D.loop_axes(a).where("frames > 0").select(F.col("image_id").alias("series_id"), F.explode("axes").alias("a")).select(
        "series_id", F.col("a.name").alias("axis"), "a.size")
    planes = D.loop_frames(a).select(F.col("image_id").alias("series_id"), "coordinates", F.expr("concat('f', frame)").alias("resource"), F.col("frame").alias("plane_order"))
    req = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("request_id"), F.col("c_custkey").alias("series_id"),
        F.expr("map('T', cast(c_custkey % 7 as int), 'Z', cast(c_custkey % 9 - 2 as int), 'P', cast(c_custkey % 4 as int))").alias("coordinates"))
    return D.lookup_planes(req, axes, planes).select("request_id", "series_id", "resource")


@query("d6_assemble_mosaic", f"""WITH {R1}, tl AS (SELECT 'm_' || (p_partkey // 50) AS image_id, p_partkey AS o, p_size * 3 + 100 AS x0, CAST((p_partkey % 10) * 6 AS INTEGER) AS y0, CAST(p_partkey % pl.n AS INTEGER) AS pg FROM part CROSS JOIN (SELECT max(vec_id) // 64 + 1 AS n FROM embeddings) pl),
ex AS (SELECT image_id, min(x0) AS mx, min(y0) AS my, max(x0 + 8) - min(x0) AS w, max(y0 + 8) - min(y0) AS h FROM tl GROUP BY ALL),
pv AS (SELECT tl.image_id, o, y0 - my + y AS y, x0 - mx + x AS x, value FROM tl JOIN ex USING (image_id) JOIN r1 ON r1.page = tl.pg AND y < 8 AND x < 8),
win AS (SELECT image_id, y, x, arg_max(value, o) AS value FROM pv GROUP BY ALL)
SELECT ex.image_id, 0 AS page, 0 AS channel, CAST(yy.i AS INTEGER) AS y, CAST(xx.i AS INTEGER) AS x, {rd("coalesce(value, 0)")} AS value FROM ex JOIN range(300) yy(i) ON yy.i < h JOIN range(300) xx(i) ON xx.i < w
LEFT JOIN win ON win.image_id = ex.image_id AND win.y = yy.i AND win.x = xx.i""")
def d6(spark, sf):
    t = views.on_planes(views.table(spark, sf, "part"), "p_partkey", spark, sf).withColumnRenamed("page", "_src").select(
        F.expr("concat('m_', p_partkey div 50)").alias("image_id"), F.lit(0).alias("page"), F.col("p_partkey").alias("tile_order"),
        F.expr("p_size * 3 + 100").alias("x0"), F.expr("cast((p_partkey % 10) * 6 as int)").alias("y0"), F.lit(8).alias("w"), F.lit(8).alias("h"),
        F.col("_src").alias("src"))
    s = views.float_stack(spark, sf).where("y < 8 and x < 8").select(F.col("page").alias("src"), "channel", "y", "x", "value")
    px = spread(t.select(*PLANE, "tile_order", "src"), *PLANE, "tile_order").join(s, "src").select(*PLANE, "tile_order", "channel", "y", "x", "value")
    return D.assemble_mosaic(t.drop("src"), px)[1].withColumn("value", rnd("value"))


_CORNERS = "(VALUES (0, -6, -4), (1, 6, -4), (2, 6, 4), (3, -6, 4)) k(i, dx, dy)"


@query("d7_rasterize_mesh", f"""WITH c AS (SELECT s_suppkey AS cell, s_suppkey % 2 AS mesh_id, (s_suppkey * 53 % 360) - 180 + 0.13::DOUBLE AS lon, (s_suppkey * 29 % 160) - 80 + 0.07::DOUBLE AS lat, s_acctbal AS v FROM supplier),
b AS (SELECT *, (CASE WHEN lon - 6 < -180 THEN lon + 360 ELSE lon END - 6 + 180) * 2 AS xl, (CASE WHEN lon - 6 < -180 THEN lon + 360 ELSE lon END + 6 + 180) * 2 AS xr, (90 - lat - 4) * 2 AS yt, (90 - lat + 4) * 2 AS yb FROM c),
p AS (SELECT mesh_id, cell, v, CAST(yy.i AS INTEGER) AS y, CAST(xx.i AS INTEGER) AS x FROM b JOIN range(360) yy(i) ON yy.i + 0.5 >= yt AND yy.i + 0.5 < yb CROSS JOIN (VALUES (-720), (0), (720)) d(s) JOIN range(720) xx(i) ON xx.i >= xl + s AND xx.i <= xr + s)
SELECT mesh_id, y, x, arg_max(v, cell) AS value FROM p GROUP BY ALL""")
def d7(spark, sf):
    c = views.table(spark, sf, "supplier").select(
        F.expr("s_suppkey % 2").alias("mesh_id"), F.col("s_suppkey").alias("cell"), F.expr("(s_suppkey * 53 % 360) - 180 + 0.13D").alias("lon"),
        F.expr("(s_suppkey * 29 % 160) - 80 + 0.07D").alias("lat"), F.col("s_acctbal").alias("value"))
    v = c.select("mesh_id", F.col("cell"), F.posexplode(F.expr(
        "array(struct(lon - 6 as lon, lat - 4 as lat), struct(lon + 6 as lon, lat - 4 as lat), struct(lon + 6 as lon, lat + 4 as lat), struct(lon - 6 as lon, lat + 4 as lat))")).alias("k", "p"))
    lon = F.expr("case when p.lon >= 180 then p.lon - 360 when p.lon < -180 then p.lon + 360 else p.lon end")
    unit = F.when(F.col("mesh_id") == 1, F.lit(3.141592653589793 / 180)).otherwise(1.0)
    v = v.select("mesh_id", (F.col("cell") * 4 + F.col("k")).alias("vertex"), (lon * unit).alias("lon"), (F.col("p.lat") * unit).alias("lat"))
    cells = c.select("mesh_id", "cell", F.expr("transform(sequence(0, 3), k -> cell * 4 + k)").alias("corner_ids"), "value")
    return D.rasterize_mesh(cells, v)


@query("d8_axis_extents", """WITH d AS (SELECT p_brand AS image_id, 'Z' AS axis, p_size % 9 AS s, p_size % 3 AS n FROM part UNION ALL SELECT p_brand, 'C', CAST(p_partkey % 4 AS INTEGER), 1 FROM part)
SELECT image_id, axis, min(s) AS min, max(s + greatest(n, 1) - 1) AS max FROM d GROUP BY ALL""")
def d8(spark, sf):
    t = views.table(spark, sf, "part").select(F.col("p_brand").alias("image_id"), F.expr(
        "map('X', struct(0 as start, 9 as size), 'M', struct(p_size as start, 1 as size), 'Z', struct(p_size % 9 as start, p_size % 3 as size), "
        "'C', struct(cast(p_partkey % 4 as int) as start, 1 as size))").alias("dims"))
    return D.axis_extents(t)


def _pgm(spark, sf):
    """Planes of the float stack as text graymap files (one bounded plane per file)."""
    s = views.float_stack(spark, sf).withColumn("v", F.expr("cast(floor((greatest(least(value, 1D), -1D) + 1) * 100) as int)"))
    f = s.groupBy(*PLANE).agg((F.max("y") + 1).alias("h"), F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda e: e["v"].cast("string")), " ").alias("body"))
    ok = f.select(F.expr("concat('/in/', image_id, '_', page, '.pgm')").alias("path"), F.encode(F.concat(
        F.lit("P2\n# plane\n64 "), F.col("h").cast("string"), F.lit("\n255\n"), F.col("body")), "utf-8").alias("content"))
    bad = f.where("page % 3 = 0").select(F.expr("concat('/in/bad_', page, '.pgm')").alias("path"), F.encode(F.lit("P2\n64 64\n255\n1 2 3"), "utf-8").alias("content"))
    return ok.unionByName(bad)


@query("s1_ingest_samples", f"WITH {R1} SELECT '/in/' || image_id || '_' || page || '.pgm' AS image_id, y, x, CAST(floor((greatest(least(value, 1), -1) + 1) * 100) AS DOUBLE) AS value FROM r1")
def s1(spark, sf):
    tiles, _, _ = S1.ingest(_pgm(spark, sf), tile=32)
    return S1.tiles_to_samples(tiles).select("image_id", "y", "x", "value")


@query("s1_ingest_quarantine", f"WITH {R1} SELECT DISTINCT '/in/bad_' || page || '.pgm' AS path FROM r1 WHERE page % 3 = 0")
def s1q(spark, sf):
    return S1.ingest(_pgm(spark, sf))[2].select("path")


@query("s1_ingest_files", f"""WITH {R2} SELECT image_id || '_' || page || '_' || (y // 16 * 16) AS file, CAST(y % 16 AS INTEGER) AS y, x, channel,
  CASE WHEN isfinite(value) THEN {rd("CAST(value AS FLOAT)::DOUBLE", 4)} END AS value FROM r2""")
def s1f(spark, sf):
    """Planes written as NPY, compressed NPZ and FITS files of 16 lines, and read back by byte ranges."""
    s = views.sparse_channels(spark, sf)
    folder = RR.make_folder(f"{ST.work_folder(spark)}/files")
    for k, kind in enumerate(("npy", "npz", "fits")):
        RR.write_bands(s.where(F.expr(f"page % 3 = {k}")), folder, kind, 16).agg(F.sum("count")).collect()
    tiles, _, _ = RR.ingest(spark, folder, tile=8)
    got = S1.tiles_to_samples(tiles)
    slot = F.when(F.col("image_id").contains(".npz#"), F.regexp_extract("image_id", r"channel(\d+)\.npy$", 1).cast("int")).otherwise(F.col("channel") + F.col("page"))
    return got.select(F.regexp_extract("image_id", r"([^/#]+)\.(npy|npz|fits)(#|$)", 1).alias("file"), "y", "x", slot.cast("int").alias("channel"),
                      rnd(nan_to_null("value"), 4).alias("value"))


def _event_stream(spark, sf):
    schema = views.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("st1_collect_results", f"""SELECT 'u_' || user_id AS image_id, event_type AS roi_kind, count(*) AS n, {rd("avg(value)", 9)} AS mean FROM events GROUP BY ALL""")
def st1(spark, sf):
    out = ST.work_folder(spark)
    rows = _event_stream(spark, sf).select(F.expr("concat('u_', user_id)").alias("image_id"), F.col("event_type").alias("roi_kind"), "value", F.lit(0).alias("version"))
    ST.collect_partials(rows, ["image_id", "roi_kind"], f"{out}/table", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return ST.merged_results(spark, f"{out}/table", ["image_id", "roi_kind"]).select("image_id", "roi_kind", "n", rnd("mean", 9).alias("mean"))


@query("st2_drop_duplicate_objects", "SELECT DISTINCT user_id, event_type FROM events")
def st2(spark, sf):
    out = ST.work_folder(spark)
    s = _event_stream(spark, sf).withColumn("ingested", F.col("ts").cast("timestamp"))
    d = ST.drop_duplicate_objects(s, ["user_id", "event_type"], "ingested", "3650 days").select("user_id", "event_type")
    d.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id bigint, event_type string").parquet(f"{out}/table")

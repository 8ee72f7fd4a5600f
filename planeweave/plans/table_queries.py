"""Tables around measurement: names, sidecars, tags, masks, exports, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import text as X
from planeweave.functions.derived import with_derived
from planeweave.functions.numeric import nan_to_null, rnd
from planeweave.functions.values import value_window
from planeweave.operators import calibration as C
from planeweave.operators import stats as A
from planeweave.plans.registry import HIST, NAMES, R1, ROIS, ROWS, number_text_sql, query, rd
from planeweave.schema import PLANE
from planeweave.sources import tables as S
from planeweave.sources import views

_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"
_KINDS = "(VALUES " + ", ".join(f"('{e}', '{k}')" for k, es in X.FORMATS.items() for e in es) + ") k(ext, kx)"


@query("s2_route_formats", f"""WITH {NAMES}
SELECT page_id, path, CASE WHEN hint IN ({", ".join(f"'{k}'" for k in X.FORMATS)}) THEN hint WHEN e = '' THEN 'dicom' ELSE kx END AS kind
FROM (SELECT *, {_EXT} AS e FROM fn) f LEFT JOIN {_KINDS} ON k.ext = f.e""")
def s2(spark, sf):
    return X.route_formats(views.file_names(spark, sf)).select("page_id", "path", "kind")


@query("s3_select_paths", f"""WITH {NAMES}
SELECT page_id, path FROM fn WHERE regexp_matches(path, '^/data/[^/]*/[^/]{{2}}_[0-5][^/]*(\\.tif|\\.png|\\.[^a-m][^/]*)$', 'i')""")
def s3(spark, sf):
    return X.select_paths(views.file_names(spark, sf), "path", "/DATA/*/??_[0-5]*{.tif,.png,.[!a-m]*}", None).select("page_id", "path")


NATURAL = """array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]')
  THEN lpad(CAST(length(regexp_replace(r, '^0+([0-9])', '\\1')) AS VARCHAR), 8, '0') || regexp_replace(r, '^0+([0-9])', '\\1') ELSE r END), '')"""


@query("o1_natural_sort", f"""WITH {NAMES}
SELECT page_id, path, {NATURAL} AS sort_key FROM fn""")
def o1(spark, sf):
    return views.file_names(spark, sf).select(
        "page_id", "path", X.natural_key("path").alias("sort_key"))


@query("o2_result_cap", f"""WITH {NAMES},
k AS (SELECT page_id, path, {NATURAL} AS sk FROM fn)
SELECT page_id, path FROM k WHERE path LIKE '/data/%/%.tif' ORDER BY sk, path LIMIT 20""")
def o2(spark, sf):
    return X.select_paths(views.file_names(spark, sf), "path", "/data/*/*.tif", 20).select("page_id", "path")


@query("o3_top1_bin", f"""WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id, page ORDER BY n DESC, bin) AS rk FROM h)
SELECT image_id, page, bin, n FROM r WHERE rk = 1""")
def o3(spark, sf):
    h = A.histogram(views.float_stack(spark, sf))
    return h.groupBy(*PLANE).agg(
        F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))


@query("o4_union_columns", f"""WITH {ROWS}
SELECT image_id, roi_id, area, mean, CAST(NULL AS DOUBLE) AS ratio FROM rws WHERE channel <= 3
UNION ALL SELECT image_id, roi_id, area, NULL, {rd("mean / area", 8)} FROM rws WHERE channel > 3""")
def o4(spark, sf):
    r = views.result_rows(spark, sf)
    a = r.where("channel <= 3").select("image_id", "roi_id", "area", "mean")
    b = r.where("channel > 3").select("image_id", "roi_id", "area", rnd(F.col("mean") / F.col("area"), 8).alias("ratio"))
    return S.append_results(a, b)


@query("u1_derived_columns", f"""WITH {ROWS}
SELECT image_id, roi_id, {rd("pow(-area, 2) + sqrt(mean) / 3", 4)} AS d1, {rd("least(mean, area * 1000::DOUBLE) - floor(mean / 7 + 0.5) * pi()", 4)} AS d2,
       {rd("CASE WHEN std = 0 THEN NULL ELSE mean / std - (mean - floor(mean / 11) * 11) END", 4)} AS d3, CAST(NULL AS DOUBLE) AS d4,
       {rd("atan2(area, mean) * 180 / pi() + ln(area) / ln(2::DOUBLE) + abs(-area)", 4)} AS d5 FROM rws""")
def u1(spark, sf):
    r = views.result_rows(spark, sf)
    texts = {"d1": "-area^2 + sqrt(mean)/3", "d2": "min(mean, area*1e3) - round(mean/7)*PI",
             "d3": "mean/std - mean % 11", "d4": "missing + area", "d5": "atan2(area, mean)*180/pi + log2(area) + abs(-area)"}
    for name, t in texts.items():
        r = with_derived(r, name, t)
    inf = float("inf")
    return r.select("image_id", "roi_id", *[
        rnd(F.when(F.abs(n) < inf, F.col(n)), 4).alias(n) for n in texts])


@query("u2_name_pattern", f"""WITH {NAMES}
SELECT page_id, CASE WHEN hit THEN regexp_extract(b, '^(.+?)_(.+?)_(.+?)\\.tif$', 1) END AS lang, CASE WHEN hit THEN regexp_extract(b, '^(.+?)_(.+?)_(.+?)\\.tif$', 2) END AS idx,
       CASE WHEN hit THEN regexp_extract(b, '^(.+?)_(.+?)_(.+?)\\.tif$', 3) END AS page FROM
(SELECT page_id, b, regexp_matches(b, '^(.+?)_(.+?)_(.+?)\\.tif$') AS hit FROM (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS b FROM fn))""")
def u2(spark, sf):
    return X.match_name_pattern(views.file_names(spark, sf), "path", "{lang}_{idx}_{page}.tif").select(
        "page_id", "lang", "idx", "page")


_U3 = """CASE WHEN l_linenumber = 1 THEN sqrt(l_extendedprice) * 1e-7::DOUBLE WHEN l_linenumber = 2 THEN sqrt(l_extendedprice) * 1e9::DOUBLE WHEN l_linenumber = 3 THEN l_quantity
  WHEN l_linenumber = 4 THEN -l_extendedprice / 13 WHEN l_linenumber = 5 AND l_tax = 0 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 AND l_tax = 0 THEN 'Infinity'::DOUBLE
  ELSE l_discount END"""


@query("u3_number_text", f"""
SELECT l_orderkey, l_partkey, l_linenumber, t AS plain, replace(t, '.', ',') AS comma,
       CASE WHEN replace(t, '.', ',') LIKE '%,%' THEN '"' || replace(t, '.', ',') || '"' ELSE replace(t, '.', ',') END AS cell
FROM (SELECT *, {number_text_sql("v")} AS t FROM (SELECT l_orderkey, l_partkey, l_linenumber, {_U3} AS v FROM lineitem))""")
def u3(spark, sf):
    v = F.expr("""case when l_linenumber = 1 then sqrt(l_extendedprice) * 1e-7D when l_linenumber = 2 then sqrt(l_extendedprice) * 1e9D when l_linenumber = 3 then l_quantity
      when l_linenumber = 4 then -l_extendedprice / 13 when l_linenumber = 5 and l_tax = 0 then double('NaN') when l_linenumber = 6 and l_tax = 0 then double('Infinity') else l_discount end""")
    comma = X.number_text(v, decimal=",")
    return views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", X.number_text(v).alias("plain"), comma.alias("comma"),
        X.quoted(comma).alias("cell"))


def _sidecar_texts(spark, sf):
    r = views.roi_table(spark, sf).select(
        F.expr("concat('img_', roi_id % 11)").alias("image_id"), F.col("roi_id").alias("id"),
        F.expr("if(roi_id % 7 = 0, null, kind)").alias("kind"), "x", "y", "width", "height", "points")
    docs = S.write_sidecars(r)
    return docs.withColumn("text", F.expr("""case when image_id = 'img_3' then substring(text, 1, 40)
        when image_id = 'img_5' then replace(text, '"version":2', '"version":9')
        when image_id = 'img_6' then '{"version":2}' else text end"""))


@query("s4_sidecar_rois", f"""WITH {ROIS}
SELECT 'img_' || (roi_id % 11) AS image_id, roi_id AS id, kind, x, y, width, height, list_aggregate(points, 'sum') AS point_sum
FROM rois WHERE roi_id % 7 <> 0 AND roi_id % 11 NOT IN (3, 6)""")
def s4(spark, sf):
    rois, _ = S.read_sidecars(_sidecar_texts(spark, sf))
    total = F.when(F.col("points").isNotNull(), F.aggregate("points", F.lit(0.0), lambda a, v: a + v))
    return rois.select("image_id", "id", "kind", "x", "y", "width", "height", total.alias("point_sum"))


@query("s4_sidecar_warnings", f"""WITH {ROIS}
SELECT 'img_' || (roi_id % 11) AS image_id, 'unreadable_entry' AS warning, count(*) AS n FROM rois WHERE roi_id % 7 = 0 AND roi_id % 11 NOT IN (3, 6) GROUP BY ALL
UNION ALL SELECT 'img_3', 'unreadable_file', 1 UNION ALL SELECT 'img_5', 'newer_version', 1 UNION ALL SELECT 'img_6', 'no_rois', 1""")
def s4w(spark, sf):
    _, warnings = S.read_sidecars(_sidecar_texts(spark, sf))
    return warnings.groupBy("image_id", "warning").agg(F.count(F.lit(1)).alias("n"))


_PROV = """pv AS (SELECT 'img_' || s_suppkey AS image_id, CASE WHEN s_suppkey % 2 = 0 THEN 'mm' ELSE 'px' END AS unit, s_acctbal / 7 AS threshold_low FROM supplier)"""


@query("s5_export_rows", f"""WITH {ROWS}, {_PROV}
SELECT image_id, roi_id, "group", CAST(channel AS VARCHAR) AS channel, {number_text_sql("area")} AS area, replace({number_text_sql("mean")}, '.', ',') AS mean,
       unit, replace({number_text_sql("threshold_low")}, '.', ',') AS threshold_low FROM rws LEFT JOIN pv USING (image_id)""")
def s5(spark, sf):
    prov = views.table(spark, sf, "supplier").select(
        F.expr("concat('img_', s_suppkey)").alias("image_id"), F.expr("if(s_suppkey % 2 = 0, 'mm', 'px')").alias("unit"),
        (F.col("s_acctbal") / 7).alias("threshold_low"))
    return S.export_rows(views.result_rows(spark, sf), prov, ["image_id", "roi_id", "group", "channel", "area", "mean"], decimal=",")


@query("s6_tag_rows", """
SELECT event_id, 'meta' AS tag_group, 'type' AS name, event_type AS value FROM events
UNION ALL SELECT event_id, 'meta', 'lens.k', regexp_extract(props, ': *([^}]*)\\}', 1) FROM events
UNION ALL SELECT event_id, 'meta', 'pos', user_id || ', 2' FROM events
UNION ALL SELECT event_id, 'meta', 'deep.a.b', CAST(event_id AS VARCHAR) FROM events""")
def s6(spark, sf):
    o = views.table(spark, sf, "events").select("event_id", F.expr(
        """concat('{"type":"', event_type, '","lens":', props, ',"none":null,"pos":[', user_id, ',2],"deep":{"a":{"b":', event_id, '}}}')""").alias("json"))
    return S.tag_rows(o, "meta", keys=("event_id",), )


_OBJ = R1 + ", m AS (SELECT page AS obj, y, x FROM r1 WHERE value > 0.1)"


@query("s8_encode_runs", f"""WITH {_OBJ},
bx AS (SELECT obj, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM m GROUP BY ALL),
g AS (SELECT obj, x0, y0, w, h, i.i AS i, i.i % w + x0 AS x, i.i // w + y0 AS y FROM bx, LATERAL (SELECT unnest(range(w * h)) AS i) i),
b AS (SELECT g.*, CASE WHEN m.obj IS NULL THEN 0 ELSE 1 END AS v FROM g LEFT JOIN m ON m.obj = g.obj AND m.x = g.x AND m.y = g.y),
c AS (SELECT *, CASE WHEN v <> coalesce(lag(v) OVER (PARTITION BY obj ORDER BY i), 0) THEN 1 ELSE 0 END AS ch FROM b),
r AS (SELECT *, sum(ch) OVER (PARTITION BY obj ORDER BY i) AS run FROM c),
n AS (SELECT obj, run, count(*) AS k FROM r GROUP BY ALL),
e AS (SELECT obj, run, k FROM n UNION ALL SELECT obj, 0, 0 FROM bx WHERE obj NOT IN (SELECT obj FROM n WHERE run = 0))
SELECT obj, x0 AS x, y0 AS y, w AS width, h AS height, list(CAST(k AS INTEGER) ORDER BY run) AS runs FROM e JOIN bx USING (obj) GROUP BY ALL""")
def s8(spark, sf):
    m = value_window(views.float_stack(spark, sf), 0.1000000001, 1e9).select(F.col("page").alias("obj"), "y", "x")
    return S.encode_runs(m, ["obj"])


@query("s8_decode_runs", f"WITH {_OBJ} SELECT obj, y, x FROM m")
def s8d(spark, sf):
    return S.decode_runs(s8(spark, sf), ["obj"])


@query("s9_replace_images", f"""WITH {ROWS}
SELECT image_id, roi_id, area, CAST(NULL AS DOUBLE) AS ratio FROM rws WHERE line_status = 'F' AND image_id NOT IN (SELECT image_id FROM rws WHERE "group" = '1-URGENT' AND channel = 7 AND area > 40)
UNION ALL SELECT image_id, roi_id, area, {rd("mean / area", 8)} FROM rws WHERE "group" = '1-URGENT' AND channel = 7 AND area > 40""")
def s9(spark, sf):
    r = views.result_rows(spark, sf)
    old = r.where("line_status = 'F'").select("image_id", "roi_id", "area")
    new = r.where("`group` = '1-URGENT' and channel = 7 and area > 40").select(
        "image_id", "roi_id", "area", rnd(F.col("mean") / F.col("area"), 8).alias("ratio"))
    return S.replace_images(old, new)


def _part_sources(spark, sf):
    p = views.table(spark, sf, "part").withColumn("image_id", F.expr("concat('p_', p_partkey)"))
    k = "p_partkey"
    tags = p.select("image_id", F.explode(F.expr(f"""array(
        struct('XResolution' as name, if({k} % 5 = 0, '1', concat(cast(p_size as string), ', 2')) as value),
        struct('YResolution' as name, if({k} % 5 = 0, '1', cast(p_size + 1 as string)) as value),
        struct('ResolutionUnit' as name, if({k} % 4 = 0, '', cast({k} % 4 as string)) as value))""")).alias("t")).select("image_id", "t.*")
    ome = p.where(f"{k} % 3 = 0").select(
        "image_id", F.expr("p_size / 10D").alias("size_x"), F.expr("p_size / 20D").alias("size_y"), F.lit(None).cast("double").alias("size_z"),
        F.expr(f"if({k} % 2 = 0, 'nm', '')").alias("unit_x"), F.expr(f"case when {k} % 9 = 0 then 'mm' else '' end").alias("unit_y"))
    dicom = p.where(f"{k} % 7 = 0").select(
        "image_id", F.expr(f"if({k} % 2 = 0, concat(p_size, '\\\\\\\\', p_size + 3), '')").alias("pixel_spacing"),
        F.expr("concat(p_size / 2D, '\\\\\\\\', p_size / 4D)").alias("imager_pixel_spacing"),
        F.expr("cast(p_size as string)").alias("slice_thickness"), F.lit("").alias("spacing_between_slices"))
    czi = p.select("image_id", F.expr("p_retailprice / 1000").alias("scaling_x_um"), F.lit(None).cast("double").alias("scaling_y_um"),
                   F.lit(-1.0).alias("scaling_z_um")).where("scaling_x_um > 1.2")
    return p, tags, ome, dicom, czi


@query("j13_calibration", f"""
SELECT image_id, {rd("coalesce(ow, tw, dw, cw, 1)", 8)} AS pixel_width, {rd("coalesce(oh, th, dh, cw, 1)", 8)} AS pixel_height,
       CASE WHEN ow IS NULL AND tw IS NULL AND dw IS NOT NULL THEN p_size::DOUBLE END AS pixel_depth,
       CASE WHEN ow IS NOT NULL THEN ou WHEN tw IS NOT NULL THEN tu WHEN dw IS NOT NULL THEN 'mm' WHEN cw IS NOT NULL THEN 'µm' ELSE 'px' END AS unit,
       CASE WHEN ow IS NOT NULL THEN 'ome' WHEN tw IS NOT NULL THEN 'tiff-resolution' WHEN dw IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'dicom' ELSE 'dicom-detector' END
            WHEN cw IS NOT NULL THEN 'czi' ELSE 'none' END AS origin
FROM (SELECT 'p_' || p_partkey AS image_id, p_partkey AS k, p_size,
   CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN p_size / 10.0::DOUBLE END AS ow, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN p_size / 20.0::DOUBLE END AS oh,
   CASE WHEN p_partkey % 2 = 0 THEN 'nm' ELSE 'µm' END AS ou,
   CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 1 THEN 2.0::DOUBLE / p_size END AS tw, CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 4 <> 1 THEN 1.0::DOUBLE / (p_size + 1) END AS th,
   CASE WHEN p_partkey % 4 = 3 THEN 'cm' ELSE 'inch' END AS tu,
   CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size + 3 ELSE p_size / 4.0::DOUBLE END END AS dw,
   CASE WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size / 2.0::DOUBLE END END AS dh,
   CASE WHEN p_retailprice / 1000 > 1.2::DOUBLE THEN p_retailprice / 1000 END AS cw FROM part)""")
def j13(spark, sf):
    p, tags, ome, dicom, czi = _part_sources(spark, sf)
    cal = C.auto_calibration(p, ome=C.from_ome(ome), tags=C.from_resolution_tags(tags), dicom=C.from_dicom(dicom), czi=C.from_scaling(czi))
    return cal.withColumn("pixel_width", rnd("pixel_width", 8)).withColumn("pixel_height", rnd("pixel_height", 8))


@query("j14_known_distance", f"""
SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0 THEN {rd("l_discount / l_quantity", 8)} END AS pixel_width, CASE WHEN l_discount > 0 THEN CASE WHEN l_linestatus = 'F' THEN 'px' ELSE 'mm' END END AS unit FROM lineitem""")
def j14(spark, sf):
    d = views.table(spark, sf, "lineitem")
    cal = C.from_known_distance(F.col("l_quantity"), F.col("l_discount"), F.expr("if(l_linestatus = 'F', '', 'mm')"))
    return d.select("l_orderkey", "l_partkey", "l_linenumber", cal.alias("c")).select(
        "l_orderkey", "l_partkey", "l_linenumber", rnd("c.pixel_width", 8).alias("pixel_width"), F.col("c.unit").alias("unit"))

"""Regions of interest on the float stack."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.numeric import nan, nan_to_null, rnd
from planeweave.operators import components as G
from planeweave.operators import rois as J
from planeweave.operators.stats import plane_headers
from planeweave.plans.registry import R1, ROIS, query, rd
from planeweave.schema import PIXEL, PLANE
from planeweave.sources import views


def outline_sql(segments: int) -> str:
    """Vertices of every vector ROI: rectangle corners, ellipse points, given points."""
    t = f"(k.i / {segments}.0::DOUBLE * 2 * pi())"
    return f"""ov AS MATERIALIZED (
  SELECT roi_id, image_id, page, kind, CAST(k.i AS INTEGER) AS i, {segments} AS n, x + width / 2 + width / 2 * cos({t}) * cos(angle) - height / 2 * sin({t}) * sin(angle) AS vx,
         y + height / 2 + width / 2 * cos({t}) * sin(angle) + height / 2 * sin({t}) * cos(angle) AS vy FROM rois CROSS JOIN range({segments}) k(i) WHERE kind = 'ellipse'
  UNION ALL SELECT roi_id, image_id, page, kind, c.i, 4, x + width / 2 + (c.sx * width * cos(angle) - c.sy * height * sin(angle)) / 2, y + height / 2 + (c.sx * width * sin(angle) + c.sy * height * cos(angle)) / 2
    FROM rois CROSS JOIN (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) c(i, sx, sy) WHERE kind = 'rect'
  UNION ALL SELECT roi_id, image_id, page, kind, CAST(k.i AS INTEGER), CAST(len(points) // 2 AS INTEGER), points[2 * k.i + 1], points[2 * k.i + 2] FROM rois JOIN range(6) k(i) ON k.i < len(points) // 2 WHERE points IS NOT NULL),
ed AS MATERIALIZED (SELECT a.roi_id, a.image_id, a.page, a.kind, a.i, a.n, a.vx AS ax, a.vy AS ay, b.vx AS bx, b.vy AS by2 FROM ov a JOIN ov b ON b.roi_id = a.roi_id AND b.i = (a.i + 1) % a.n)"""


HD = "hd AS MATERIALIZED (SELECT image_id, page, max(x) + 1 AS pw, max(y) + 1 AS ph FROM r1 GROUP BY ALL)"
SPANS = f"""{R1}, {ROIS}, {outline_sql(256)}, {HD},
cx AS (SELECT roi_id, image_id, page, pw, CAST(yy.i AS INTEGER) AS y, ax + ((yy.i + 0.5::DOUBLE - ay) / (by2 - ay)) * (bx - ax) AS c FROM ed JOIN hd USING (image_id, page)
  JOIN rois USING (roi_id, image_id, page, kind) JOIN range(64) yy(i) ON yy.i < ph AND ((ay <= yy.i + 0.5 AND by2 > yy.i + 0.5) OR (by2 <= yy.i + 0.5 AND ay > yy.i + 0.5))
  WHERE kind IN ('ellipse', 'polygon') OR (kind = 'rect' AND angle <> 0)),
cr AS (SELECT *, row_number() OVER (PARTITION BY roi_id, y ORDER BY c) - 1 AS k FROM cx),
pr AS (SELECT roi_id, image_id, page, y, k // 2 AS k, min(c) AS c0, max(c) AS c1, any_value(pw) AS pw FROM cr GROUP BY roi_id, image_id, page, y, k // 2 HAVING count(*) = 2),
px AS MATERIALIZED (
  SELECT DISTINCT roi_id, pr.image_id, pr.page, pr.y, CAST(xx.i AS INTEGER) AS x FROM pr JOIN range(64) xx(i) ON xx.i < pw AND xx.i >= c0 - 0.5 AND xx.i <= c1 - 0.5
  UNION ALL SELECT roi_id, image_id, page, CAST(yy.i AS INTEGER), CAST(xx.i AS INTEGER) FROM rois JOIN hd USING (image_id, page) JOIN range(64) yy(i) ON yy.i < ph AND yy.i >= floor(y + 0.5) AND yy.i < floor(y + height + 0.5)
    JOIN range(64) xx(i) ON xx.i < pw AND xx.i >= floor(x + 0.5) AND xx.i < floor(x + width + 0.5) WHERE kind = 'rect' AND angle = 0)"""


def _base(spark, sf):
    s = views.float_stack(spark, sf)
    return views.roi_table(spark, sf), s, plane_headers(s)


@query("j1_rasterize", f"WITH {SPANS} SELECT roi_id, image_id, page, y, x FROM px")
def j1(spark, sf):
    rois, _, planes = _base(spark, sf)
    return J.rasterize(rois, planes).withColumn("x", F.explode(F.sequence("x_start", "x_end"))).select("roi_id", *PIXEL)


@query("j2_roi_samples", f"WITH {SPANS} SELECT roi_id, image_id, page, channel, y, x, {rd('value')} AS value FROM px JOIN r1 USING (image_id, page, y, x)")
def j2(spark, sf):
    rois, s, planes = _base(spark, sf)
    return J.spans_with_samples(J.rasterize(rois, planes), s).withColumn("value", rnd("value"))


_HOLED = "sm AS (SELECT image_id, page, channel, y, x, CASE WHEN value > 0.25 THEN 'NaN'::DOUBLE ELSE value END AS value FROM r1)"
_A7 = f"""js AS MATERIALIZED (SELECT roi_id, image_id, page, channel, y, x, CASE WHEN isfinite(value) THEN value END AS v FROM px JOIN sm USING (image_id, page, y, x)),
st AS (SELECT roi_id, image_id, page, channel, count(v) AS n, count(*) - count(v) AS nf, avg(v) AS mean, min(v) AS lo, max(v) AS hi, sum(v) AS total, median(v) AS med, stddev_samp(v) AS sd FROM js GROUP BY ALL),
mo AS (SELECT js.roi_id, avg((v - mean) ** 2) AS m2, avg((v - mean) ** 3) AS m3, avg((v - mean) ** 4) AS m4, sum((v - least(lo, 0)) * x) / sum(v - least(lo, 0)) AS cmx, sum((v - least(lo, 0)) * y) / sum(v - least(lo, 0)) AS cmy FROM js JOIN st USING (roi_id) GROUP BY ALL),
mb AS (SELECT js.roi_id, lo, hi, least(255, CAST(floor((v - lo) * (256.0::DOUBLE / (hi - lo))) AS INTEGER)) AS bin, count(*) AS k FROM js JOIN st USING (roi_id) WHERE v IS NOT NULL AND hi > lo GROUP BY ALL),
md AS (SELECT roi_id, lo + (bin + 0.5::DOUBLE) / (256.0::DOUBLE / (hi - lo)) AS mode FROM (SELECT *, row_number() OVER (PARTITION BY roi_id ORDER BY k DESC, bin) AS rk FROM mb) WHERE rk = 1)"""


def _holed(s):
    return s.withColumn("value", F.when(F.col("value") > 0.25, nan()).otherwise(F.col("value")))


@query("a7_roi_intensity", f"""WITH {SPANS}, {_HOLED}, {_A7}
SELECT roi_id, image_id, page, channel, n AS count, nf AS non_finite_count, {rd("mean")} AS mean, {rd("coalesce(sd, 0)")} AS std, {rd("lo")} AS min, {rd("hi")} AS max, {rd("total")} AS sum, {rd("med")} AS median,
       {rd("coalesce(mode, lo)")} AS mode, {rd("CASE WHEN m2 > 0 THEN m3 / (sqrt(m2) * sqrt(m2) * sqrt(m2)) ELSE 0 END")} AS skewness, {rd("CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END")} AS kurtosis,
       {rd("cmx")} AS center_of_mass_x, {rd("cmy")} AS center_of_mass_y FROM st JOIN mo USING (roi_id) LEFT JOIN md USING (roi_id)""")
def a7(spark, sf):
    rois, s, planes = _base(spark, sf)
    g = J.roi_intensity(J.spans_with_samples(J.rasterize(rois, planes), _holed(s)))
    num = ("mean", "std", "min", "max", "sum", "median", "mode", "skewness", "kurtosis", "center_of_mass_x", "center_of_mass_y")
    return g.select("roi_id", *PLANE, "channel", "count", "non_finite_count", *[rnd(c).alias(c) for c in num])


_PROFILE = f"""vt AS (SELECT roi_id, image_id, page, line_width, CAST(k.i AS INTEGER) AS i, len(points) // 2 AS n, points[2 * k.i + 1] AS vx, points[2 * k.i + 2] AS vy FROM rois JOIN range(6) k(i) ON k.i < len(points) // 2 WHERE kind IN ('line', 'polyline')),
sg AS (SELECT a.*, b.vx AS bx, b.vy AS by2, sqrt((b.vx - a.vx) ** 2 + (b.vy - a.vy) ** 2) AS ln FROM vt a JOIN vt b ON a.roi_id = b.roi_id AND b.i = a.i + 1),
cu AS MATERIALIZED (SELECT *, sum(ln) OVER (PARTITION BY roi_id ORDER BY i) AS c1, sum(ln) OVER (PARTITION BY roi_id) AS total FROM sg),
ps AS (SELECT roi_id, image_id, page, line_width, s.i AS s, total, s.i::DOUBLE / (greatest(2, floor(total + 0.5) + 1) - 1) * total AS d FROM (SELECT DISTINCT roi_id, image_id, page, line_width, total FROM cu) u JOIN range(200) s(i) ON s.i <= greatest(2, floor(total + 0.5) + 1) - 1),
sq AS (SELECT ps.*, cu.i AS seg, vx, vy, bx, by2, ln, (d - (c1 - ln)) / ln AS t, row_number() OVER (PARTITION BY ps.roi_id, s ORDER BY CASE WHEN c1 >= d - 1e-9::DOUBLE THEN 0 ELSE 1 END, CASE WHEN c1 >= d - 1e-9::DOUBLE THEN cu.i ELSE -cu.i END) AS rk FROM ps JOIN cu USING (roi_id)),
bp AS (SELECT sq.roi_id, sq.image_id, sq.page, s, d, k.i AS k, vx + t * (bx - vx) - (by2 - vy) / ln * (k.i - (line_width - 1) / 2.0::DOUBLE) AS qx, vy + t * (by2 - vy) + (bx - vx) / ln * (k.i - (line_width - 1) / 2.0::DOUBLE) AS qy
  FROM sq JOIN range(3) k(i) ON k.i < line_width WHERE rk = 1),
bc AS (SELECT bp.*, pw, ph, greatest(0, least(qx, pw - 1)) AS fx, greatest(0, least(qy, ph - 1)) AS fy FROM bp JOIN hd USING (image_id, page) WHERE qx >= -0.5 AND qy >= -0.5 AND qx <= pw - 0.5 AND qy <= ph - 0.5),
vl AS (SELECT bc.*, a.value AS v00, b.value AS v10, c.value AS v01, e.value AS v11 FROM bc
  JOIN sm a ON a.image_id = bc.image_id AND a.page = bc.page AND a.y = floor(fy)::INTEGER AND a.x = floor(fx)::INTEGER JOIN sm b ON b.image_id = bc.image_id AND b.page = bc.page AND b.y = floor(fy)::INTEGER AND b.x = least(floor(fx)::INTEGER + 1, pw - 1)
  JOIN sm c ON c.image_id = bc.image_id AND c.page = bc.page AND c.y = least(floor(fy)::INTEGER + 1, ph - 1) AND c.x = floor(fx)::INTEGER JOIN sm e ON e.image_id = bc.image_id AND e.page = bc.page AND e.y = least(floor(fy)::INTEGER + 1, ph - 1) AND e.x = least(floor(fx)::INTEGER + 1, pw - 1)),
bv AS (SELECT roi_id, s, k, CASE WHEN isfinite(v00) AND isfinite(v10) AND isfinite(v01) AND isfinite(v11)
    THEN (v00 + (fx - floor(fx)) * (v10 - v00)) + (fy - floor(fy)) * ((v01 + (fx - floor(fx)) * (v11 - v01)) - (v00 + (fx - floor(fx)) * (v10 - v00)))
    ELSE CASE WHEN fy - floor(fy) >= 0.5 THEN CASE WHEN fx - floor(fx) >= 0.5 THEN v11 ELSE v01 END ELSE CASE WHEN fx - floor(fx) >= 0.5 THEN v10 ELSE v00 END END END AS v FROM vl),
pf AS MATERIALIZED (SELECT ps.roi_id, ps.image_id, ps.page, ps.s, ps.d, avg(v) FILTER (isfinite(v)) AS value FROM ps LEFT JOIN bv USING (roi_id, s) GROUP BY ALL)"""
_SMM = _HOLED.replace("sm AS (", "sm AS MATERIALIZED (")


@query("j3_line_profile", f"WITH {R1}, {ROIS}, {HD}, {_SMM}, {_PROFILE} SELECT roi_id, image_id, page, 0 AS channel, CAST(s AS INTEGER) AS s, {rd('d')} AS distance, {rd('value')} AS value FROM pf")
def j3(spark, sf):
    rois, s, planes = _base(spark, sf)
    p = J.line_profile(rois, _holed(s), planes)
    return p.select("roi_id", *PLANE, "channel", "s", rnd("distance").alias("distance"), rnd(nan_to_null("value")).alias("value"))


@query("j4_line_rows", f"""WITH {R1}, {ROIS}, {HD}, {_SMM}, {_PROFILE},
an AS (SELECT roi_id, CASE WHEN len(points) = 4 THEN degrees(atan2(-(points[4] - points[2]) * 0.5::DOUBLE, (points[3] - points[1]) * 2.0::DOUBLE)) END AS a FROM rois),
le AS (SELECT roi_id, sum(sqrt(((bx - vx) * 2) ** 2 + ((by2 - vy) * 0.5::DOUBLE) ** 2)) AS length FROM sg GROUP BY ALL)
SELECT roi_id, image_id, page, 0 AS channel, {rd("any_value(length)")} AS length, {rd("any_value(CASE WHEN a < 0 THEN a + 180 ELSE a END)")} AS angle, count(value) AS pixel_count, count(*) - count(value) AS non_finite_count,
       {rd("avg(value)")} AS mean, {rd("coalesce(stddev_samp(value), 0)")} AS std, {rd("min(value)")} AS min, {rd("max(value)")} AS max, {rd("coalesce(sum(value), 0)")} AS sum FROM pf JOIN an USING (roi_id) JOIN le USING (roi_id) GROUP BY ALL""")
def j4(spark, sf):
    rois, s, planes = _base(spark, sf)
    g = J.line_rows(rois, J.line_profile(rois, _holed(s), planes), 2.0, 0.5)
    return g.select("roi_id", *PLANE, "channel", *[rnd(c).alias(c) for c in ("length", "angle", "mean", "std", "min", "max", "sum")],
                    "pixel_count", "non_finite_count")


@query("j5_point_rows", f"""WITH {R1}, {ROIS}, {_SMM},
pt AS (SELECT roi_id, image_id, page, CAST(floor(points[2 * k.i + 1] + 0.5) AS INTEGER) AS x, CAST(floor(points[2 * k.i + 2] + 0.5) AS INTEGER) AS y FROM rois JOIN range(3) k(i) ON k.i < len(points) // 2 WHERE kind = 'point')
SELECT pt.roi_id, pt.image_id, pt.page, 0 AS channel, count(*) AS pixel_count, {rd("avg(pt.x) * 2")} AS centroid_x, {rd("avg(pt.y)")} AS centroid_y, {rd("avg(value) FILTER (isfinite(value))")} AS mean,
       {rd("min(value) FILTER (isfinite(value))")} AS min, {rd("max(value) FILTER (isfinite(value))")} AS max, count(*) - count(CASE WHEN isfinite(value) THEN 1 END) AS non_finite_count
FROM pt LEFT JOIN sm USING (image_id, page, y, x) GROUP BY ALL""")
def j5(spark, sf):
    rois, s, planes = _base(spark, sf)
    ch = planes.select(*PLANE, F.explode(F.expr("sequence(0, channels - 1)")).alias("channel"))
    g = J.point_rows(rois, _holed(s), ch, 2.0, 1.0)
    return g.select("roi_id", *PLANE, "channel", "pixel_count", "non_finite_count",
                    *[rnd(c).alias(c) for c in ("centroid_x", "centroid_y", "mean", "min", "max")])


_ELL = """mm AS (SELECT roi_id, image_id, page, count(*) AS n, min(x) AS bx, min(y) AS y0, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, avg(x) AS cx, avg(y) AS cy,
   var_pop(x) * 4 + 4 / 12.0::DOUBLE AS xx, var_pop(y) + 1 / 12.0::DOUBLE AS yy, covar_pop(x, y) * 2 AS xy FROM px GROUP BY ALL),
el AS (SELECT *, 4 * sqrt((xx + yy + sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2) AS a0, 4 * sqrt((xx + yy - sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2) AS b0, -degrees(atan2(2 * xy, xx - yy)) / 2 AS g FROM mm),
es AS (SELECT *, a0 * sqrt(n * 2 / (pi() / 4 * a0 * b0)) AS major, b0 * sqrt(n * 2 / (pi() / 4 * a0 * b0)) AS minor, CASE WHEN g < 0 THEN g + 180 ELSE g END AS g2 FROM el)"""


@query("j6_ellipse_fit", f"""WITH {SPANS}, {_ELL}
SELECT roi_id, image_id, page, n AS pixel_count, bx, y0 AS by, w AS width, h AS height, {rd("cx")} AS centroid_x, {rd("cy")} AS centroid_y, {rd("major", 4)} AS major, {rd("minor", 4)} AS minor,
       CASE WHEN abs(xy) < 1e-9::DOUBLE THEN NULL ELSE {rd("CASE WHEN g2 >= 180 THEN g2 - 180 ELSE g2 END", 4)} END AS angle FROM es""")
def j6(spark, sf):
    rois, _, planes = _base(spark, sf)
    g = J.span_shape(J.rasterize(rois, planes), 2.0, 1.0)
    # The angle of a region without covariance hangs on the sign of a rounding error.
    tilted = F.least(F.abs(F.col("angle")), F.abs(F.col("angle") - 90), F.abs(F.col("angle") - 180)) > 1e-6
    return g.select("roi_id", *PLANE, "pixel_count", "bx", "by", "width", "height", rnd("centroid_x").alias("centroid_x"),
                    rnd("centroid_y").alias("centroid_y"), rnd("major", 4).alias("major"), rnd("minor", 4).alias("minor"),
                    F.when(tilted, rnd("angle", 4)).alias("angle"))


@query("j7_polygon_measures", f"""WITH {ROIS}, {outline_sql(96)}
SELECT roi_id, image_id, page, kind, {rd("abs(sum(ax * by2 - bx * ay)) / 2 * 2 * 0.5::DOUBLE")} AS area, {rd("sum(sqrt(((bx - ax) * 2) ** 2 + ((by2 - ay) * 0.5::DOUBLE) ** 2))")} AS perimeter,
       {rd("coalesce(sum(sqrt(((bx - ax) * 2) ** 2 + ((by2 - ay) * 0.5::DOUBLE) ** 2)) FILTER (i < n - 1), 0)")} AS open_length FROM ed GROUP BY ALL""")
def j7(spark, sf):
    r = views.roi_table(spark, sf).withColumn("o", J.outline())
    return r.select("roi_id", *PLANE, "kind", rnd(J.polygon_area(J.edges("o"), 2.0, 0.5)).alias("area"),
                    rnd(J.length(J.edges("o"), 2.0, 0.5)).alias("perimeter"),
                    rnd(J.length(J.edges("o", closed=False), 2.0, 0.5)).alias("open_length"))


@query("j8_mask_contours")
def j8(spark, sf):
    s = views.float_stack(spark, sf)
    labels = G.label_components(s.where("value > 0.12").select(*PIXEL), 8)
    return J.mask_contours(labels, [*PLANE, "label"]).withColumn("perimeter", rnd("perimeter"))


@query("j9_feret", f"""WITH {ROIS}, {outline_sql(96)},
o2 AS MATERIALIZED (SELECT roi_id, image_id, page, kind, i, vx * 2 AS vx, vy * 0.5::DOUBLE AS vy FROM ov WHERE kind IN ('rect', 'ellipse', 'polygon')),
mx AS (SELECT a.roi_id, max(sqrt((a.vx - b.vx) ** 2 + (a.vy - b.vy) ** 2)) AS feret FROM o2 a JOIN o2 b USING (roi_id) GROUP BY ALL),
ln AS (SELECT a.roi_id, a.i, b.i AS j, min(((c.vx - a.vx) * (b.vy - a.vy) - (c.vy - a.vy) * (b.vx - a.vx)) / sqrt((a.vx - b.vx) ** 2 + (a.vy - b.vy) ** 2)) AS lo, max(((c.vx - a.vx) * (b.vy - a.vy) - (c.vy - a.vy) * (b.vx - a.vx)) / sqrt((a.vx - b.vx) ** 2 + (a.vy - b.vy) ** 2)) AS hi
  FROM o2 a JOIN o2 b ON b.roi_id = a.roi_id AND b.i <> a.i AND (b.vx <> a.vx OR b.vy <> a.vy) JOIN o2 c ON c.roi_id = a.roi_id GROUP BY ALL),
mn AS (SELECT roi_id, min(hi) AS min_feret FROM ln WHERE lo > -1e-9::DOUBLE GROUP BY ALL)
SELECT DISTINCT o2.roi_id, image_id, page, kind, {rd("feret")} AS feret, {rd("min_feret")} AS min_feret FROM o2 JOIN mx USING (roi_id) JOIN mn USING (roi_id)""")
def j9(spark, sf):
    r = views.roi_table(spark, sf).where("kind in ('rect', 'ellipse', 'polygon')")
    f = r.select("roi_id", *PLANE, "kind", J.feret(J.outline(), 2.0, 0.5).alias("f"))
    return f.select("roi_id", *PLANE, "kind", rnd("f.feret").alias("feret"), rnd("f.min_feret").alias("min_feret"))


@query("j10_shape_descriptors", """
SELECT p_partkey, round(least(1, 4 * pi() * p_size / ((p_retailprice / 50) * (p_retailprice / 50))), 6) + 0::DOUBLE AS circularity, round((p_partkey % 40) / nullif((p_partkey % 7)::DOUBLE, 0), 6) AS aspect_ratio,
       round(4 * p_size / (pi() * nullif((p_partkey % 40)::DOUBLE, 0) * (p_partkey % 40)), 6) AS roundness FROM part""")
def j10(spark, sf):
    d = J.shape_descriptors(F.col("p_size").cast("double"), F.col("p_retailprice") / 50, F.expr("cast(p_partkey % 40 as double)"), F.expr("cast(p_partkey % 7 as double)"))
    return views.table(spark, sf, "part").select("p_partkey", *[rnd(c).alias(n) for n, c in d.items()])


@query("j11_area_rows", f"""WITH {SPANS}, {_HOLED}, {_A7}, {_ELL},
o96 AS MATERIALIZED ({outline_sql(96).split("MATERIALIZED (", 1)[1].split(chr(10) + "ed AS", 1)[0].rstrip().rstrip(",").rstrip(")")}),
e96 AS (SELECT a.roi_id, a.kind, sum(sqrt(((b.vx - a.vx) * 2) ** 2 + (b.vy - a.vy) ** 2)) AS perimeter FROM o96 a JOIN o96 b ON b.roi_id = a.roi_id AND b.i = (a.i + 1) % a.n GROUP BY ALL)
SELECT es.roi_id, es.image_id, es.page, channel, kind, es.n AS pixel_count, es.n * 2.0::DOUBLE AS area, {rd("perimeter", 9)} AS perimeter, {rd("major", 9)} AS major, {rd("minor", 9)} AS minor, es.cx * 0 + {rd("es.cx * 2", 9)} AS centroid_x,
       {rd("least(1, 4 * pi() * es.n * 2 / (perimeter * perimeter))", 9)} AS circularity, {rd("major / minor", 9)} AS aspect_ratio, {rd("4 * es.n * 2 / (pi() * major * major)", 9)} AS roundness,
       {rd("mean", 9)} AS mean, {rd("med", 9)} AS median, {rd("es.n * 2 * mean", 9)} AS integrated_density, {rd("total", 9)} AS raw_integrated_density, {rd("cmx * 2", 9)} AS center_of_mass_x, nf AS non_finite_count
FROM es JOIN e96 USING (roi_id) JOIN st USING (roi_id) JOIN mo USING (roi_id)""")
def j11(spark, sf):
    rois, s, planes = _base(spark, sf)
    g = J.area_rows(rois, _holed(s), planes, 2.0, 1.0)
    num = ("perimeter", "major", "minor", "centroid_x", "circularity", "aspect_ratio", "roundness", "mean", "median",
           "integrated_density", "raw_integrated_density", "center_of_mass_x")
    return g.select("roi_id", *PLANE, "channel", "kind", "pixel_count", "area", "non_finite_count", *[rnd(c, 9).alias(c) for c in num])


_PTS = """pts AS (SELECT c_custkey AS point_id, 'emb_' || ((c_custkey % pl.n) // 8) AS image_id, CAST(c_custkey % pl.n AS INTEGER) AS page, (c_custkey * 37 % 640) / 10.0::DOUBLE AS px, (c_custkey * 53 % 640) / 10.0::DOUBLE AS py FROM customer CROSS JOIN (SELECT max(vec_id) // 64 + 1 AS n FROM embeddings) pl)"""
_HIT = f"""{ROIS}, {outline_sql(96)}, {_PTS},
bb AS MATERIALIZED (SELECT roi_id, image_id, page, kind, min(vx) - 3 AS x0, max(vx) + 3 AS x1, min(vy) - 3 AS y0, max(vy) + 3 AS y1 FROM ov GROUP BY ALL),
cand AS MATERIALIZED (SELECT point_id, px, py, bb.* FROM pts JOIN bb USING (image_id, page) WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1),
ee AS (SELECT c.*, ax, ay, bx, by2, CASE WHEN (bx - ax) ** 2 + (by2 - ay) ** 2 = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by2 - ay)) / ((bx - ax) ** 2 + (by2 - ay) ** 2))) END AS t
  FROM cand c JOIN ed e ON e.roi_id = c.roi_id WHERE e.kind IN ('rect', 'ellipse', 'polygon') OR e.i < e.n - 1),
ht AS (SELECT point_id, ee.roi_id, ee.image_id, ee.page, px, py, min(sqrt((ax + t * (bx - ax) - px) ** 2 + (ay + t * (by2 - ay) - py) ** 2)) AS distance,
   count(*) FILTER ((ay > py) <> (by2 > py) AND px < (ax - bx) * (py - by2) / (ay - by2) + bx) % 2 = 1 AS odd FROM ee GROUP BY ALL)"""


def _points(spark, sf):
    return views.on_planes(views.table(spark, sf, "customer"), "c_custkey", spark, sf).select(
        F.col("c_custkey").alias("point_id"), "image_id", "page",
        F.expr("(c_custkey * 37 % 640) / 10D").alias("px"), F.expr("(c_custkey * 53 % 640) / 10D").alias("py"))


@query("j12_hit_test", f"""WITH {_HIT}
SELECT point_id, roi_id, ht.image_id, ht.page, px, py, {rd("distance")} AS distance, CASE WHEN kind = 'rect' AND angle = 0 THEN px >= x AND py >= y AND px <= x + width AND py <= y + height
   WHEN kind IN ('rect', 'ellipse', 'polygon') THEN odd ELSE false END AS inside FROM ht JOIN rois USING (roi_id)""")
def j12(spark, sf):
    return J.hit_test(_points(spark, sf), views.roi_table(spark, sf), 3.0).withColumn("distance", rnd("distance"))


@query("j12_nearest_roi", f"""WITH {ROIS}, {outline_sql(96)}, {_PTS},
ee AS (SELECT point_id, px, py, ax, ay, bx, by2, e.roi_id, CASE WHEN (bx - ax) ** 2 + (by2 - ay) ** 2 = 0 THEN 0 ELSE greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by2 - ay)) / ((bx - ax) ** 2 + (by2 - ay) ** 2))) END AS t
  FROM pts JOIN ed e USING (image_id, page) WHERE e.kind IN ('rect', 'ellipse', 'polygon') OR e.i < e.n - 1),
ds AS (SELECT point_id, roi_id, min(sqrt((ax + t * (bx - ax) - px) ** 2 + (ay + t * (by2 - ay) - py) ** 2)) AS distance FROM ee GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(distance, 9), roi_id) AS rk FROM ds)
SELECT pts.point_id, pts.image_id, pts.page, r.roi_id, {rd("r.distance")} AS distance FROM pts LEFT JOIN r ON r.point_id = pts.point_id AND rk = 1""")
def j12n(spark, sf):
    return J.nearest_roi(_points(spark, sf), views.roi_table(spark, sf)).withColumn("distance", rnd("distance"))

"""Value layer: decoding, shaping and selecting samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import values as V
from planeweave.functions.numeric import nan, nan_to_null, rnd
from planeweave.operators.stats import plane_headers
from planeweave.plans.registry import R1, R2, query, rd
from planeweave.schema import PIXEL, PLANE, SAMPLE
from planeweave.sources import views


@query("v1_rescale", f"""WITH {R2}
SELECT image_id, page, channel, y, x,
       CASE WHEN value IN (7, 25, 50) THEN NULL ELSE {rd("CAST(100 + 2.5::DOUBLE * value AS FLOAT)::DOUBLE", 4)} END AS value
FROM r2 WHERE isfinite(value)""")
def v1(spark, sf):
    s = views.sparse_channels(spark, sf).where(V.finite("value"))
    out = s.withColumn("value", V.rescale("value", 2.5, 100.0, fill=[7.0, 25.0, 50.0]))
    return out.select(*SAMPLE, rnd(nan_to_null("value"), 4).alias("value"))


@query("v2_invert_planes", f"""WITH {R1},
f AS (SELECT image_id, page, min(value) lo, max(value) hi FROM r1 GROUP BY ALL)
SELECT image_id, page, channel, y, x, {rd("hi + lo - value")} AS value FROM r1 JOIN f USING (image_id, page)""")
def v2(spark, sf):
    return V.invert_planes(views.float_stack(spark, sf)).select(*SAMPLE, rnd("value").alias("value"))


@query("v3_stored_bits", """
SELECT l_orderkey, l_partkey, l_linenumber, raw, raw & 4095 AS kept,
       CASE WHEN raw & 4095 >= 2048 THEN (raw & 4095) - 4096 ELSE raw & 4095 END AS signed
FROM (SELECT l_orderkey, l_partkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS raw FROM lineitem)""")
def v3(spark, sf):
    d = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.floor("l_extendedprice").alias("raw"))
    return d.select("*", V.stored_bits("raw", 12, False).alias("kept"),
                    V.stored_bits("raw", 12, True).alias("signed"))


@query("v4_scaled_domain", f"""
SELECT p_partkey, {rd("least(a, b)", 4)} AS domain_min, {rd("greatest(a, b)", 4)} AS domain_max
FROM (SELECT p_partkey, p_retailprice + (10 - p_size)::DOUBLE * -32768 AS a, p_retailprice + (10 - p_size)::DOUBLE * 32767 AS b FROM part)""")
def v4(spark, sf):
    lo, hi = V.scaled_domain(-32768, 32767, (10 - F.col("p_size")).cast("double"), F.col("p_retailprice"))
    return views.table(spark, sf, "part").select(
        "p_partkey", rnd(lo, 4).alias("domain_min"), rnd(hi, 4).alias("domain_max"))


@query("v5_nodata", f"""WITH {R2},
nd AS (SELECT 'li_' || user_id % 8 AS image_id, min_by(value, event_id) AS nodata FROM
       (SELECT user_id, event_id, round(value) AS value FROM events WHERE event_type = 'click' AND isfinite(value)) GROUP BY 1)
SELECT image_id, page, channel, count(*) AS n, {rd("sum(value)", 4)} AS total
FROM r2 LEFT JOIN nd USING (image_id) WHERE isfinite(value) AND (nodata IS NULL OR value <> nodata) GROUP BY ALL""")
def v5(spark, sf):
    # Clicks stand for nodata tags: their rounded value is the sentinel text.
    tags = views.table(spark, sf, "events").select(
        F.expr("concat('li_', user_id % 8)").alias("image_id"), F.lit(None).cast("int").alias("tag"),
        F.expr("if(event_type = 'click', 'GDAL_NODATA', event_type)").alias("name"),
        F.round("value").cast("string").alias("value"), F.col("event_id").alias("tag_order"))
    s = V.drop_nodata(views.sparse_channels(spark, sf).where(V.finite("value")), V.nodata_from_tags(tags))
    return s.groupBy(*PLANE, "channel").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("v6_rgb24", f"""WITH {R2},
p AS (SELECT image_id, page, y, x, max(CASE WHEN channel = 0 THEN floor(value) END)::BIGINT r, max(CASE WHEN channel = 1 THEN floor(value) END)::BIGINT g,
             max(CASE WHEN channel = 2 THEN floor(value) END)::BIGINT b FROM r2 WHERE isfinite(value) GROUP BY ALL)
SELECT image_id, page, y, x, r * 65536 + g * 256 + b AS value24 FROM p WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL""")
def v6(spark, sf):
    return V.rgb24(views.sparse_channels(spark, sf))


SCALAR_R2 = """s2 AS (
  SELECT image_id, page, y, x, 0.2126::DOUBLE * max(CASE WHEN channel = 0 THEN value END) + 0.7152::DOUBLE * max(CASE WHEN channel = 1 THEN value END)
         + 0.0722::DOUBLE * max(CASE WHEN channel = 2 THEN value END) AS value FROM r2 GROUP BY ALL)"""


@query("v7_scalar_plane", f"""WITH {R2}, {SCALAR_R2}
SELECT image_id, page, y, x, CASE WHEN isfinite(value) THEN {rd("value")} END AS value FROM s2""")
def v7(spark, sf):
    return V.scalar_plane(views.sparse_channels(spark, sf)).select(*PIXEL, rnd(nan_to_null("value")).alias("value"))


@query("v8_flip_vertical", f"""WITH {R1}, hd AS (SELECT image_id, page, max(y) + 1 AS height FROM r1 GROUP BY ALL)
SELECT image_id, page, channel, height - 1 - y AS y, x, {rd("value")} AS value FROM r1 JOIN hd USING (image_id, page)""")
def v8(spark, sf):
    s = views.float_stack(spark, sf)
    return V.flip_vertical(s, plane_headers(s)).select(*SAMPLE, rnd("value").alias("value"))


@query("v9_value_window", f"""WITH {R2}
SELECT image_id, page, channel, y, x FROM r2 WHERE isfinite(value) AND value BETWEEN 12.5 AND 30""")
def v9(spark, sf):
    return V.value_window(views.sparse_channels(spark, sf), 12.5, 30.0).select(*SAMPLE)


@query("v10_mask_conditions", f"""WITH {R2}
SELECT image_id, page, channel, op, count(*) AS kept FROM r2, (VALUES ('gt'), ('ge'), ('lt'), ('le'), ('eq'), ('isfinite'), ('isnan'), ('none')) o(op)
WHERE CASE op WHEN 'gt' THEN isfinite(value) AND value > 25 WHEN 'ge' THEN isfinite(value) AND value >= 25
  WHEN 'lt' THEN isfinite(value) AND value < 25 WHEN 'le' THEN isfinite(value) AND value <= 25
  WHEN 'eq' THEN isfinite(value) AND value = 25 WHEN 'isfinite' THEN isfinite(value)
  WHEN 'isnan' THEN NOT isfinite(value) ELSE true END GROUP BY ALL""")
def v10(spark, sf):
    ops = [*V.CONDITIONS, "none"]
    s = views.sparse_channels(spark, sf)
    g = s.groupBy(*PLANE, "channel").agg(
        *[F.count(F.when(V.keep_condition("value", op, 25.0), 1)).alias(op) for op in ops])
    return g.unpivot([*PLANE, "channel"], ops, "op", "kept").where("kept > 0")


@query("v11_inspect_points", f"""WITH {R2},
pts AS (SELECT c_custkey AS point_id, 'li_' || ((c_custkey % pl.n) // 8) AS image_id, CAST(c_custkey % pl.n AS INTEGER) AS page, CAST(c_custkey % 64 AS INTEGER) AS y, CAST(c_custkey * 5 % 64 AS INTEGER) AS x FROM customer CROSS JOIN (SELECT max(l_orderkey) // 4096 + 1 AS n FROM lineitem) pl)
SELECT point_id, image_id, page, y, x, list(CASE WHEN isfinite(value) THEN {rd("value")} END ORDER BY channel) AS values
FROM pts JOIN r2 USING (image_id, page, y, x) GROUP BY ALL""")
def v11(spark, sf):
    planes = views.table(spark, sf, "lineitem").agg(F.expr("max(l_orderkey) div 4096 + 1").alias("_planes"))
    pts = views.table(spark, sf, "customer").crossJoin(F.broadcast(planes)).select(
        F.col("c_custkey").alias("point_id"), F.expr("concat('li_', (c_custkey % _planes) div 8)").alias("image_id"), F.expr("cast(c_custkey % _planes as int)").alias("page"),
        F.expr("cast(c_custkey % 64 as int)").alias("y"), F.expr("cast(c_custkey * 5 % 64 as int)").alias("x"))
    out = V.inspect_points(views.sparse_channels(spark, sf), pts)
    return out.withColumn("values", F.transform("values", lambda v: rnd(nan_to_null(v))))


@query("v12_select_planes", f"""WITH {R2}
SELECT image_id, page, channel, count(*) AS n, count(CASE WHEN isfinite(value) THEN 1 END) AS covered FROM r2
WHERE page IN (0, 2, 5) AND channel = 1 GROUP BY ALL""")
def v12(spark, sf):
    s = V.select_planes(views.sparse_channels(spark, sf), page=[0, 2, 5], channel=1)
    return s.groupBy(*PLANE, "channel").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(V.finite("value"), 1)).alias("covered"))


@query("s7_deinterleave", f"""
SELECT 'emb' AS image_id, CAST(vec_id // 64 AS INTEGER) AS page, CAST(vec_id % 64 AS INTEGER) AS y,
       CAST(p % 4 AS INTEGER) AS channel, CAST(p // 4 AS INTEGER) AS x, {rd("v")} AS value,
       ['Red', 'Green', 'Blue', 'Alpha'][p % 4 + 1] AS channel_name
FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""")
def s7(spark, sf):
    lines = views.table(spark, sf, "embeddings").select(
        F.lit("emb").alias("image_id"), F.expr("cast(vec_id div 64 as int)").alias("page"),
        F.expr("cast(vec_id % 64 as int)").alias("y"), F.lit(4).alias("channels"), F.col("embedding").alias("data"))
    return V.deinterleave(lines).withColumn("value", rnd("value"))

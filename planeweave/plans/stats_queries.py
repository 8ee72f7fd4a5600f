"""Aggregates over planes, channels, masks and result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions import values as V
from planeweave.functions.numeric import nan_to_null, rnd
from planeweave.operators import stats as A
from planeweave.plans.registry import HIST, R1, R2, ROWS, query, rd
from planeweave.plans.value_queries import SCALAR_R2
from planeweave.schema import PIXEL, PLANE
from planeweave.sources import views


@query("a1_image_stats", f"""WITH {R2}
SELECT image_id, page, {rd("min(v)")} AS min, {rd("max(v)")} AS max, {rd("avg(v)")} AS mean,
       {rd("sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0))")} AS std, count(v) AS valid_count,
       count(*) - count(v) AS non_finite_count, count(*) AS total_count
FROM (SELECT image_id, page, CASE WHEN isfinite(value) THEN value END AS v FROM r2 WHERE channel < 3) GROUP BY ALL""")
def a1(spark, sf):
    s = A.image_stats(views.sparse_channels(spark, sf))
    return s.select(*PLANE, *[rnd(c).alias(c) for c in ("min", "max", "mean", "std")],
                    "valid_count", "non_finite_count", "total_count")


@query("a2_channel_ranges", f"""WITH {R2}
SELECT image_id, page, channel, coalesce(min(value) FILTER (isfinite(value)), 0) AS min, coalesce(max(value) FILTER (isfinite(value)), 1) AS max,
       count(*) FILTER (isfinite(value)) AS count, count(*) FILTER (NOT isfinite(value)) AS non_finite_count FROM r2 GROUP BY ALL""")
def a2(spark, sf):
    return A.channel_ranges(views.sparse_channels(spark, sf))


@query("a3_histogram", f"""WITH {HIST}
SELECT image_id, page, bin, n, {rd("lo")} AS lo, {rd("hi")} AS hi FROM h WHERE n > 0""")
def a3(spark, sf):
    h = A.histogram(views.float_stack(spark, sf))
    return h.withColumn("lo", rnd("lo")).withColumn("hi", rnd("hi"))


def _trunc(v: str) -> str:
    return f"greatest(0, least(255, CAST(trunc(({v} - 0) * (1.0::DOUBLE / 50) * 255) AS INTEGER)))"


A4_SQL = f"""WITH {R2},
p AS (SELECT image_id, page, y, x, max(CASE WHEN channel = 0 THEN value END) r, max(CASE WHEN channel = 1 THEN value END) g, max(CASE WHEN channel = 2 THEN value END) b
      FROM r2 GROUP BY ALL),
f AS (SELECT image_id, page, {_trunc("r")} br, {_trunc("g")} bg, {_trunc("b")} bb FROM p WHERE isfinite(r) AND isfinite(g) AND isfinite(b)),
u AS (SELECT image_id, page, br AS bin, 0 AS c FROM f UNION ALL SELECT image_id, page, bg, 1 FROM f UNION ALL SELECT image_id, page, bb, 2 FROM f),
hh AS (SELECT image_id, page, bin, count(*) FILTER (c = 0) AS r, count(*) FILTER (c = 1) AS g, count(*) FILTER (c = 2) AS b FROM u GROUP BY ALL),
dh AS (SELECT *, CASE WHEN bool_and(r = g AND r = b) OVER (PARTITION BY image_id, page) THEN r
   ELSE CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS BIGINT) END AS luminance FROM hh)"""


def _display(spark, sf):
    s = views.sparse_channels(spark, sf)
    ranges = s.select(*PLANE).distinct().select(*PLANE, F.lit(0.0).alias("lo"), F.lit(50.0).alias("hi"))
    return A.display_histogram(s, ranges)


@query("a4_display_histogram", A4_SQL + " SELECT * FROM dh")
def a4(spark, sf):
    return _display(spark, sf)


@query("a4_display_bin_stats", A4_SQL + f""" SELECT image_id, page, min(bin) FILTER (luminance > 0) AS min_bin, max(bin) FILTER (luminance > 0) AS max_bin,
  {rd("sum(bin * luminance)::DOUBLE / sum(luminance)")} AS mean_bin, CAST(sum(luminance) AS BIGINT) AS total FROM dh GROUP BY ALL""")
def a4b(spark, sf):
    return A.bin_stats(_display(spark, sf)).withColumn("mean_bin", rnd("mean_bin"))


@query("a5_channel_histograms", f"""WITH {R2}
SELECT image_id, page, channel, greatest(0, least(255, CAST(floor((value - (channel * 5 + 5)) * (256.0::DOUBLE / 30)) AS INTEGER))) AS bin, count(*) AS n
FROM r2 WHERE isfinite(value) GROUP BY ALL""")
def a5(spark, sf):
    s = views.sparse_channels(spark, sf)
    lo = (F.col("channel") * 5 + 5).cast("double")
    settings = s.select(*PLANE, "channel").distinct().select(
        *PLANE, "channel", lo.alias("lo"), (lo + 30).alias("hi"))
    return A.channel_histograms(s, settings)


@query("a6_auto_range", f"""WITH {R1},
st AS (SELECT image_id, page, channel, min(value) lo, max(value) hi, count(*) cnt FROM r1 GROUP BY ALL),
b AS (SELECT image_id, page, channel, greatest(0, least(4095, CAST(floor((value - lo) * (4096.0::DOUBLE / (hi - lo))) AS INTEGER))) AS bin, count(*) AS n
      FROM r1 JOIN st USING (image_id, page, channel) GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY image_id, page, channel ORDER BY bin) AS cum FROM b JOIN st USING (image_id, page, channel)),
e AS (SELECT image_id, page, channel, any_value(lo) lo, any_value(hi) hi, min(bin) FILTER (cum >= cnt * 0.001::DOUBLE) b0, min(bin) FILTER (cum >= cnt * 0.999::DOUBLE) b1 FROM c GROUP BY ALL)
SELECT image_id, page, channel, {rd("lo + b0 / 4096.0::DOUBLE * (hi - lo)")} AS lo, {rd("lo + (b1 + 1) / 4096.0::DOUBLE * (hi - lo)")} AS hi FROM e""")
def a6(spark, sf):
    return A.auto_range(views.float_stack(spark, sf)).withColumn("lo", rnd("lo")).withColumn("hi", rnd("hi"))


@query("a8_group_summary", f"""WITH {ROWS}
SELECT "group", line_status, count(mean) AS n, {rd("avg(mean)", 3)} AS mean, {rd("stddev_samp(mean)", 3)} AS sd, {rd("stddev_samp(mean) / sqrt(count(mean))", 3)} AS sem,
       {rd("min(mean)", 3)} AS min, {rd("max(mean)", 3)} AS max FROM rws GROUP BY ALL""")
def a8(spark, sf):
    g = A.group_summary(views.result_rows(spark, sf), ["group", "line_status"], "mean")
    return g.select("group", "line_status", "n", *[rnd(c, 3).alias(c) for c in ("mean", "sd", "sem", "min", "max")])


def _col_summary(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, {rd(f"avg({c})", 3)} AS mean, {rd(f"stddev_samp({c})", 3)} AS sd,
    {rd(f"stddev_samp({c}) / sqrt(count({c}))", 3)} AS sem, {rd(f"min({c})", 3)} AS min, {rd(f"max({c})", 3)} AS max FROM rws"""


@query("a9_summary_all", f"WITH {ROWS} " + " UNION ALL ".join(_col_summary(c) for c in ("area", "mean", "std")))
def a9(spark, sf):
    g = A.summary_all(views.result_rows(spark, sf), [])
    return g.select("column", "n", *[rnd(c, 3).alias(c) for c in ("mean", "sd", "sem", "min", "max")])


@query("a10_difference", f"""WITH {R2},
d AS (SELECT image_id, page, y, x, channel, value AS a, CASE WHEN value > 40 THEN value - 3 ELSE value + 0.5 END AS b FROM r2 WHERE isfinite(value)),
p AS (SELECT image_id, page, y, x, sum(abs(a - b)) s, max(abs(a - b)) m, count(*) k FROM d GROUP BY ALL)
SELECT image_id, page, {rd("sum(s) / sum(k)")} AS mean_abs_error, {rd("max(m)")} AS max_abs_error, {rd("avg(CASE WHEN m > 1 THEN 1.0::DOUBLE ELSE 0 END)")} AS differing_ratio FROM p GROUP BY ALL""")
def a10(spark, sf):
    a = views.sparse_channels(spark, sf).where(V.finite("value"))
    b = a.withColumn("value", F.expr("if(value > 40, value - 3, value + 0.5D)"))
    d = A.difference_metrics(a, b)
    return d.select(*PLANE, *[rnd(c).alias(c) for c in ("mean_abs_error", "max_abs_error", "differing_ratio")])


@query("a11_box_downsample", f"""WITH {R2}, {SCALAR_R2}
SELECT image_id, page, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, {rd("CAST(avg(CASE WHEN isfinite(value) THEN value END) AS FLOAT)::DOUBLE", 4)} AS value
FROM s2 WHERE y // 3 < 21 AND x // 3 < 21 GROUP BY ALL""")
def a11(spark, sf):
    s = V.scalar_plane(views.sparse_channels(spark, sf))
    hdr = s.groupBy(*PLANE).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return A.box_downsample(s, hdr, 500).select(*PIXEL, rnd(nan_to_null("value"), 4).alias("value"))


@query("a14_coverage_range", f"""WITH {R2}
SELECT image_id, page, coalesce(min(value) FILTER (cov AND isfinite(value)), 0) AS min, coalesce(max(value) FILTER (cov AND isfinite(value)), 0) AS max, count(*) FILTER (cov) AS covered_count
FROM (SELECT image_id, page, value, (x + y) % 3 <> 0 AS cov FROM r2 WHERE channel = 0) GROUP BY ALL""")
def a14(spark, sf):
    s = views.sparse_channels(spark, sf).where("channel = 0").withColumn("covered", F.expr("(x + y) % 3 <> 0"))
    return A.coverage_range(s)

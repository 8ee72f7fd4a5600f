"""Global threshold methods on the float stack, and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.numeric import rnd
from planeweave.functions.values import scalar_plane
from planeweave.operators import stats as A
from planeweave.operators import thresholds as T
from planeweave.plans.registry import HIST, query, rd
from planeweave.schema import PLANE
from planeweave.sources import views

CUM = HIST + """,
d AS (SELECT *, sum(n) OVER w AS c, sum(bin * n) OVER w AS s, sum(n * n) OVER w AS q,
        sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END) OVER w AS g, sum(n) OVER v AS cn, sum(bin * n) OVER v AS sn, sum(n * n) OVER v AS qn,
        sum(CASE WHEN n > 0 THEN n * ln(n) ELSE 0 END) OVER v AS gn
      FROM h WINDOW w AS (PARTITION BY image_id, page ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY image_id, page))"""

EDGE = rd("lo + (threshold_bin + 1) / 256.0::DOUBLE * (hi - lo)")


def _criterion(crit: str, valid: str, order: str = "DESC") -> str:
    return f"""WITH {CUM},
k AS (SELECT *, {crit} AS v FROM d WHERE {valid}),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, page ORDER BY v {order}, bin) AS rk FROM k),
t AS (SELECT image_id, page, lo, hi, bin AS threshold_bin FROM r WHERE rk = 1)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t"""


OTSU = _criterion("""c::DOUBLE * (cn - c)::DOUBLE * (s::DOUBLE / c - (sn - s)::DOUBLE / (cn - c)) * (s::DOUBLE / c - (sn - s)::DOUBLE / (cn - c))""",
                  "c > 0 AND cn - c > 0")


def _run(method):
    def fn(spark, sf):
        t = T.auto_threshold(A.histogram(views.float_stack(spark, sf)), method)
        return t.select(*PLANE, "threshold_bin", rnd("threshold").alias("threshold"))
    return fn


query("t1_otsu", OTSU)(_run("otsu"))
# Iterative methods: a row per step in a recursive table, the last step decides.
_STEPS = "WITH RECURSIVE " + CUM + """,
dm AS MATERIALIZED (SELECT * FROM d),
tot AS MATERIALIZED (SELECT image_id, page, lo, hi, cn, sn, min(bin) FILTER (n > 0) AS fst FROM dm GROUP BY ALL)"""
_BIN = f"CASE WHEN threshold_bin >= 0 THEN {EDGE} END AS threshold"
query("t2_isodata", f"""{_STEPS},
it AS (SELECT image_id, page, 0 AS i, 128 AS t, false AS done FROM tot
  UNION ALL SELECT image_id, page, i + 1, CASE WHEN nt IS NULL THEN t ELSE nt END, nt IS NULL OR nt = t FROM (
    SELECT it.*, CAST(floor((s / nullif(c, 0)::DOUBLE + (sn - s) / nullif(cn - c, 0)::DOUBLE) / 2 + 0.5) AS INTEGER) AS nt
    FROM it JOIN dm ON dm.image_id = it.image_id AND dm.page = it.page AND dm.bin = greatest(0, least(255, it.t)) WHERE NOT done AND i < 1000)),
t AS (SELECT tot.image_id, tot.page, lo, hi, greatest(arg_max(it.t, i), any_value(fst)) AS threshold_bin FROM it JOIN tot USING (image_id, page) GROUP BY ALL)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("isodata"))
query("t3_li", f"""{_STEPS},
it AS (SELECT image_id, page, 0 AS i, sn::DOUBLE / cn AS t, false AS done FROM tot
  UNION ALL SELECT image_id, page, i + 1, nt, nt IS NULL OR abs(nt - t) <= 0.5 FROM (
    SELECT *, CASE WHEN low <> high THEN (high - low) / (ln(high) - ln(low)) END AS nt FROM (
      SELECT it.*, greatest(CASE WHEN c > 0 THEN s::DOUBLE / c ELSE 0 END, 1e-9::DOUBLE) AS low, greatest(CASE WHEN cn > c THEN (sn - s)::DOUBLE / (cn - c) ELSE 0 END, 1e-9::DOUBLE) AS high
      FROM it JOIN dm ON dm.image_id = it.image_id AND dm.page = it.page AND dm.bin = greatest(0, least(255, CAST(floor(it.t + 0.5) AS INTEGER))) WHERE NOT done AND i < 1000))),
t AS (SELECT tot.image_id, tot.page, lo, hi, CAST(coalesce(floor(arg_max_null(it.t, i)), 0) AS INTEGER) AS threshold_bin FROM it JOIN tot USING (image_id, page) GROUP BY ALL)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("li"))
query("t4_triangle", f"""WITH {HIST},
f AS (SELECT image_id, page, min(bin) FILTER (n > 0) AS fst, max(bin) FILTER (n > 0) AS lst, max(n) AS top FROM h GROUP BY ALL),
pk AS (SELECT f.*, min(bin) AS peak, max(bin) AS peak_r FROM f JOIN h USING (image_id, page) WHERE n = top GROUP BY ALL),
o AS (SELECT h.*, fst, lst, top, peak - fst < lst - peak AS flip, CASE WHEN peak - fst < lst - peak THEN 255 - bin ELSE bin END AS b,
        CASE WHEN peak - fst < lst - peak THEN 255 - peak_r ELSE peak END AS p, CASE WHEN peak - fst < lst - peak THEN 255 - fst ELSE lst END AS e
      FROM h JOIN pk USING (image_id, page)),
en AS (SELECT image_id, page, n AS end_n FROM o WHERE b = e),
ds AS (SELECT o.*, abs((end_n - top) * (b - p) - (e - p) * (n - top)) / sqrt(((e - p) * (e - p) + (end_n - top) * (end_n - top))::DOUBLE) AS dist
       FROM o JOIN en USING (image_id, page) WHERE b BETWEEN p AND e),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, page ORDER BY dist DESC, b) AS rk FROM ds),
t AS (SELECT image_id, page, lo, hi, CASE WHEN flip THEN 255 - b ELSE b END AS threshold_bin FROM r WHERE rk = 1)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("triangle"))
_a = "((q / (cn::DOUBLE * cn)) * ((qn - q) / (cn::DOUBLE * cn)))"
_b = "((c / cn::DOUBLE) * (1 - c / cn::DOUBLE))"
query("t5_yen", _criterion(f"(CASE WHEN {_a} > 0 THEN -ln({_a}) ELSE 0 END) + (CASE WHEN {_b} > 0 THEN 2 * ln({_b}) ELSE 0 END)",
                           "n > 0 OR bin = 0"))(_run("yen"))
query("t6_huang", f"""WITH {CUM},
e AS (SELECT image_id, page, min(bin) FILTER (n > 0) AS fst, max(bin) FILTER (n > 0) AS lst FROM h GROUP BY ALL),
m AS (SELECT d.*, fst, lst, CASE WHEN c > 0 THEN floor(s::DOUBLE / c + 0.5) ELSE 0 END AS ml, CASE WHEN cn > c THEN floor((sn - s)::DOUBLE / (cn - c) + 0.5) ELSE 0 END AS mh
      FROM d JOIN e USING (image_id, page) WHERE bin BETWEEN fst AND lst),
x AS (SELECT m.image_id, m.page, m.lo, m.hi, m.bin AS t, h.n, m.lst - m.fst AS span, abs(h.bin - CASE WHEN h.bin <= m.bin THEN ml ELSE mh END) AS dst
      FROM m JOIN h USING (image_id, page)),
c2 AS (SELECT *, 1 / (1 + dst::DOUBLE / span) AS mu FROM x),
en AS (SELECT image_id, page, lo, hi, t, round(sum(n * CASE WHEN dst = 0 THEN 0 ELSE -mu * ln(mu) - (1 - mu) * ln(1 - mu) END), 9) AS entropy FROM c2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, page ORDER BY entropy, t) AS rk FROM en),
t AS (SELECT image_id, page, lo, hi, t AS threshold_bin FROM r WHERE rk = 1)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("huang"))
query("t7_max_entropy", _criterion("round(ln(c) - g / c + ln(cn - c) - (gn - g) / (cn - c), 12)", "n > 0 AND c > 0 AND cn - c > 0"))(_run("max_entropy"))
query("t8_mean", f"""WITH {HIST},
t AS (SELECT image_id, page, lo, hi, CAST(floor(sum(bin * n)::DOUBLE / sum(n)) AS INTEGER) AS threshold_bin FROM h GROUP BY ALL)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("mean"))
query("t9_moments", f"""WITH {CUM},
m AS (SELECT image_id, page, sum(bin * n)::DOUBLE / sum(n) AS m1, sum(bin::BIGINT * bin * n)::DOUBLE / sum(n) AS m2, sum(bin::BIGINT * bin * bin * n)::DOUBLE / sum(n) AS m3 FROM h GROUP BY ALL),
k AS (SELECT *, (m1 * m3 - m2 * m2) / (m2 - m1 * m1) AS c0, (m2 * m1 - m3) / (m2 - m1 * m1) AS c1 FROM m),
z AS (SELECT *, sqrt(c1 * c1 - 4 * c0) AS root FROM k),
p AS (SELECT image_id, page, ((-c1 + root) / 2 - m1) / root AS p0 FROM z),
t AS (SELECT image_id, page, any_value(lo) AS lo, any_value(hi) AS hi, min(bin) FILTER (c::DOUBLE / cn > p0) AS threshold_bin FROM d JOIN p USING (image_id, page) GROUP BY image_id, page)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("moments"))
query("t10_percentile", _criterion("abs(c::DOUBLE / cn - 0.5)", "true", "ASC"))(_run("percentile"))
# Every split with every bin of each side; below the split, the j-th bin meets the product that has used up the j bins from the split down.
query("t11_shanbhag", f"""WITH {CUM},
pr AS MATERIALIZED (SELECT image_id, page, lo, hi, bin, n::DOUBLE / cn AS p, c::DOUBLE / cn AS pb, (cn - c)::DOUBLE / cn AS pf, c > 0 AND c < cn AS ok FROM d),
sd AS (SELECT a.image_id, a.page, a.bin AS t, 0 AS side, b.bin AS j, b.p AS w, 1 - r.p / a.pb AS f, a.pb AS mass FROM pr a JOIN pr b ON b.image_id = a.image_id AND b.page = a.page AND b.bin BETWEEN 1 AND a.bin
    JOIN pr r ON r.image_id = a.image_id AND r.page = a.page AND r.bin = a.bin - b.bin + 1 WHERE a.ok
  UNION ALL SELECT a.image_id, a.page, a.bin, 1, b.bin, b.p, 1 - b.p / a.pf, a.pf FROM pr a JOIN pr b ON b.image_id = a.image_id AND b.page = a.page AND b.bin > a.bin WHERE a.ok),
lf AS (SELECT *, product(f) OVER (PARTITION BY image_id, page, t, side ORDER BY j ROWS UNBOUNDED PRECEDING) AS lft FROM sd),
st AS (SELECT *, min(CASE WHEN lft <= 1e-13 THEN j END) OVER (PARTITION BY image_id, page, t, side) AS stop FROM lf),
en AS (SELECT image_id, page, t, coalesce(-sum(w * ln(lft)) FILTER (side = 0 AND j < coalesce(stop, 256)) / any_value(mass) FILTER (side = 0), 0) AS back,
       coalesce(-sum(w * ln(lft)) FILTER (side = 1 AND j < coalesce(stop, 256)) / any_value(mass) FILTER (side = 1), 0) AS fore FROM st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, page ORDER BY round(abs(back - fore), 10), t) AS rk FROM en),
t AS (SELECT pr.image_id, pr.page, lo, hi, bin AS threshold_bin FROM r JOIN pr ON pr.image_id = r.image_id AND pr.page = r.page AND pr.bin = r.t WHERE rk = 1)
SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t""")(_run("shanbhag"))
_PEAKS = "list_filter(range(2, 256), lambda x: h[x - 1] < h[x] AND h[x + 1] < h[x])"
_SMOOTHED = f"""WITH RECURSIVE {HIST},
it AS (SELECT image_id, page, lo, hi, 0 AS i, list(n::DOUBLE ORDER BY bin) AS h FROM h GROUP BY ALL
  UNION ALL SELECT image_id, page, lo, hi, i + 1, list_transform(range(1, 257), lambda x: (h[greatest(x - 1, 1)] + h[x] + h[least(x + 1, 256)]) / 3.0::DOUBLE) FROM it WHERE len({_PEAKS}) > 2 AND i < 9999),
lst AS (SELECT image_id, page, lo, hi, arg_max(h, i) AS h FROM it GROUP BY ALL), pk AS (SELECT *, {_PEAKS} AS peaks FROM lst)"""
query("t12_minimum", f"""{_SMOOTHED},
t AS (SELECT image_id, page, lo, hi, CAST(CASE WHEN len(peaks) = 2 THEN coalesce(list_filter(range(2, 256), lambda x: h[x - 1] > h[x] AND h[x + 1] >= h[x])[1] - 1, -1) ELSE -1 END AS INTEGER) AS threshold_bin FROM pk)
SELECT image_id, page, threshold_bin, {_BIN} FROM t""")(_run("minimum"))
query("t13_intermodes", f"""{_SMOOTHED},
t AS (SELECT image_id, page, lo, hi, CAST(CASE WHEN len(peaks) = 2 THEN (peaks[1] + peaks[2] - 2) // 2 ELSE -1 END AS INTEGER) AS threshold_bin FROM pk)
SELECT image_id, page, threshold_bin, {_BIN} FROM t""")(_run("intermodes"))


@query("flagship_otsu_foreground", OTSU.replace(f"SELECT image_id, page, threshold_bin, {EDGE} AS threshold FROM t", f"""
SELECT image_id, page, threshold_bin, {EDGE} AS threshold, count(*) FILTER (value >= lo + (threshold_bin + 1) / 256.0::DOUBLE * (hi - lo)) AS foreground,
       {rd("avg(CASE WHEN value >= lo + (threshold_bin + 1) / 256.0::DOUBLE * (hi - lo) THEN 1.0::DOUBLE ELSE 0 END)")} AS area_fraction
FROM r1 JOIN t USING (image_id, page) GROUP BY ALL"""))
def flagship(spark, sf):
    plane = scalar_plane(views.float_stack(spark, sf))
    cut = T.auto_threshold(A.histogram(plane), "otsu")
    on = F.col("value") >= F.col("threshold")
    return (plane.where(F.abs("value") < float("inf")).join(cut, PLANE)
            .groupBy(*PLANE, "threshold_bin", "threshold")
            .agg(F.count(F.when(on, 1)).alias("foreground"), F.avg(on.cast("double")).alias("area_fraction"))
            .withColumn("threshold", rnd("threshold")).withColumn("area_fraction", rnd("area_fraction")))

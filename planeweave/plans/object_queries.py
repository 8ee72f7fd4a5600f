"""Components, objects, splitting, region growing, stability curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.numeric import rnd
from planeweave.operators import components as G, growth
from planeweave.operators import objects as O
from planeweave.operators.stats import plane_headers
from planeweave.plans.registry import HIST, R1, query, rd
from planeweave.schema import PIXEL, PLANE
from planeweave.sources import views

# Recursive reachability per plane is quadratic at worst; the planes are 64 x 64.
_LAB = R1 + """, m AS MATERIALIZED (SELECT image_id, page, y, x, y * 64 + x AS i FROM r1 WHERE value > 0.12)"""


def _components(src: str, out: str, eight: bool) -> str:
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if eight else "abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"""{out}_e AS MATERIALIZED (SELECT a.image_id, a.page, a.i, b.i AS j FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND a.page = b.page AND {near} AND a.i <> b.i),
{out}_r(image_id, page, i, root) AS (
  SELECT image_id, page, i, i FROM {src}
  UNION
  SELECT e.image_id, e.page, e.j, r.root FROM {out}_r r JOIN {out}_e e ON e.image_id = r.image_id AND e.page = r.page AND e.i = r.i WHERE e.j > r.root),
{out}_m AS (SELECT image_id, page, i, min(root) AS root FROM {out}_r GROUP BY ALL),
{out} AS MATERIALIZED (SELECT image_id, page, CAST(i // 64 AS INTEGER) AS y, CAST(i % 64 AS INTEGER) AS x, i, dense_rank() OVER (PARTITION BY image_id, page ORDER BY root) AS label FROM {out}_m)"""


def _mask(spark, sf, cut=0.12):
    return views.float_stack(spark, sf).where(F.col("value") > cut).select(*PIXEL)


def _planes(spark, sf):
    return plane_headers(views.float_stack(spark, sf))


@query("g1_components_8", f"WITH RECURSIVE {_LAB}, {_components('m', 'l', True)} SELECT image_id, page, y, x, label FROM l")
def g1(spark, sf):
    return G.label_components(_mask(spark, sf), 8, tile=16)


@query("g1_components_4", f"WITH RECURSIVE {_LAB}, {_components('m', 'l', False)} SELECT image_id, page, y, x, label FROM l")
def g1b(spark, sf):
    return G.label_components(_mask(spark, sf), 4, tile=32)


_OBJ = f"""{_LAB}, {_components('m', 'l', False)}, hd AS (SELECT image_id, page, max(x) AS mx, max(y) AS my FROM r1 GROUP BY ALL)"""


@query("a12_extract_objects", f"""WITH RECURSIVE {_OBJ}
SELECT image_id, page, label, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area,
       bool_or(x = 0 OR y = 0 OR x = mx OR y = my) AS touches_edge FROM l JOIN hd USING (image_id, page) GROUP BY ALL""")
def a12(spark, sf):
    return O.extract_objects(G.label_components(_mask(spark, sf), 4), _planes(spark, sf))


_JUDGE = f"""WITH RECURSIVE {_OBJ},
ob AS (SELECT image_id, page, label, count(*) AS area, bool_or(x = 0 OR y = 0 OR x = mx OR y = my) AS edge FROM l JOIN hd USING (image_id, page) GROUP BY ALL),
be AS (SELECT l.image_id, l.page, l.label, sum(CASE WHEN n.label IS NULL OR n.label <> l.label THEN 1 ELSE 0 END) AS edges
       FROM l CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) LEFT JOIN l n ON n.image_id = l.image_id AND n.page = l.page AND n.y = l.y + dy AND n.x = l.x + dx GROUP BY ALL),
jd AS (SELECT *, CASE WHEN edge THEN 'edge' WHEN area < 2 THEN 'small' WHEN area > 60 THEN 'large'
    WHEN least(1, 4 * pi() * area / ((edges * 0.95::DOUBLE) * (edges * 0.95::DOUBLE))) < 0.5 THEN 'shape' END AS rejected FROM ob JOIN be USING (image_id, page, label))"""


def _judged(spark, sf):
    return O.analyze_objects(_mask(spark, sf), _planes(spark, sf), connectivity=4, min_area=2, max_area=60,
                             min_circularity=0.5, exclude_edges=True)[0]


@query("a13_rejection_counts", _JUDGE + """
SELECT image_id, page, count(*) FILTER (rejected = 'edge') AS edge, count(*) FILTER (rejected = 'small') AS too_small, count(*) FILTER (rejected = 'large') AS too_large,
       count(*) FILTER (rejected = 'shape') AS shape, count(*) AS total_before_filters FROM jd GROUP BY ALL""")
def a13(spark, sf):
    return O.rejection_counts(_judged(spark, sf))


@query("g6_analyze_objects", _JUDGE + f"""
SELECT image_id, page, label, area, CAST(edges AS BIGINT) AS boundary_edges, {rd("least(1, 4 * pi() * area / ((edges * 0.95::DOUBLE) * (edges * 0.95::DOUBLE)))")} AS quick_circularity, rejected FROM jd""")
def g6(spark, sf):
    return _judged(spark, sf).select(*PLANE, "label", "area", "boundary_edges", rnd("quick_circularity").alias("quick_circularity"), "rejected")


@query("g2_fill_holes", f"""WITH RECURSIVE {R1}, m AS MATERIALIZED (SELECT image_id, page, y, x, y * 64 + x AS i FROM r1 WHERE value > 0), {_components('m', 'l', True)},
bx AS MATERIALIZED (SELECT image_id, page, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM l GROUP BY ALL HAVING max(x) - min(x) >= 2 AND max(y) - min(y) >= 2),
bg AS MATERIALIZED (SELECT b.image_id, b.page, b.label, x0, x1, y0, y1, CAST(yy.i AS INTEGER) AS y, CAST(xx.i AS INTEGER) AS x FROM bx b JOIN range(64) yy(i) ON yy.i BETWEEN y0 AND y1 JOIN range(64) xx(i) ON xx.i BETWEEN x0 AND x1
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.image_id = b.image_id AND l.page = b.page AND l.label = b.label AND l.y = yy.i AND l.x = xx.i)),
outside(image_id, page, label, y, x) AS (
  SELECT image_id, page, label, y, x FROM bg WHERE x IN (x0, x1) OR y IN (y0, y1)
  UNION
  SELECT bg.image_id, bg.page, bg.label, bg.y, bg.x FROM
    (SELECT o.image_id, o.page, o.label, o.y + dy AS y, o.x + dx AS x FROM outside o CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx)) o
    JOIN bg ON bg.image_id = o.image_id AND bg.page = o.page AND bg.label = o.label AND bg.y = o.y AND bg.x = o.x)
SELECT image_id, page, label, y, x FROM l
UNION ALL SELECT bg.image_id, bg.page, bg.label, bg.y, bg.x FROM bg WHERE NOT EXISTS
  (SELECT 1 FROM outside o WHERE o.image_id = bg.image_id AND o.page = bg.page AND o.label = bg.label AND o.y = bg.y AND o.x = bg.x)""")
def g2(spark, sf):
    return O.fill_holes(G.label_components(_mask(spark, sf, 0.0), 8))


@query("g3_split_by_shape")
def g3(spark, sf):
    return O.split_by_shape(_mask(spark, sf, 0.0), _planes(spark, sf))


@query("g4_split_by_intensity")
def g4(spark, sf):
    return O.split_by_intensity(_mask(spark, sf, 0.0), views.float_stack(spark, sf), 0.05)


@query("g5_count_maxima")
def g5(spark, sf):
    return O.count_maxima(_mask(spark, sf, 0.0), views.float_stack(spark, sf), 0.05)


@query("g9_objects_to_rois", f"""WITH RECURSIVE {_OBJ}
SELECT image_id, page, label, 'mask' AS kind, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height,
       CAST((max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS BIGINT) AS run_total, CAST(count(*) AS BIGINT) AS on_total FROM l GROUP BY ALL""")
def g9(spark, sf):
    r = O.objects_to_rois(G.label_components(_mask(spark, sf), 4))
    total = F.aggregate("runs", F.lit(0).cast("long"), lambda a, v: a + v)
    on = F.aggregate(F.filter("runs", lambda v, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, v: a + v)
    # A mask whose last run is on ends its array there; otherwise the zeros close the box.
    return r.select(*PLANE, "label", "kind", "x", "y", "width", "height", total.alias("run_total"), on.alias("on_total"))


_SEED = """sd AS (SELECT s_suppkey AS seed_id, 'emb_' || ((s_suppkey % pl.n) // 8) AS image_id, CAST(s_suppkey % pl.n AS INTEGER) AS page, CAST(s_suppkey * 3 % 64 AS INTEGER) AS y, CAST(s_suppkey * 7 % 64 AS INTEGER) AS x FROM supplier CROSS JOIN (SELECT max(vec_id) // 64 + 1 AS n FROM embeddings) pl)"""


def _grow_sql(tol: str) -> str:
    """Breadth-first growth of (seed, step) rows with column ``tol``."""
    return f"""gr(seed_id, step, page, y, x) AS (
  SELECT seed_id, step, page, y, x FROM tl
  UNION
  SELECT g.seed_id, g.step, g.page, p.y, p.x FROM (SELECT g.*, t.tol, t.v0, g.y + dy AS ny, g.x + dx AS nx FROM gr g JOIN tl t USING (seed_id, step) CROSS JOIN range(-1, 2) a(dy) CROSS JOIN range(-1, 2) b(dx)) g
    JOIN r1 p ON p.page = g.page AND p.y = g.ny AND p.x = g.nx WHERE abs(p.value - g.v0) <= g.tol)"""


def _seeds(spark, sf):
    return views.on_planes(views.table(spark, sf, "supplier"), "s_suppkey", spark, sf).select(
        F.col("s_suppkey").alias("seed_id"), "image_id", "page",
        F.expr("cast(s_suppkey * 3 % 64 as int)").alias("y"), F.expr("cast(s_suppkey * 7 % 64 as int)").alias("x"))


#: Half of each plane's pixels; the last plane may be lower than the others.
_CAP = """pc AS (SELECT page, floor((max(x) + 1) * (max(y) + 1) * 0.5::DOUBLE) AS cap FROM r1 GROUP BY page)"""
_R1M = R1.replace("r1 AS (", "r1 AS MATERIALIZED (")


@query("g7_grow_regions", f"""WITH RECURSIVE {_R1M}, {_SEED},
tl AS MATERIALIZED (SELECT sd.*, 0 AS step, 0.03::DOUBLE AS tol, r1.value AS v0 FROM sd JOIN r1 USING (image_id, page, y, x)),
{_grow_sql('tol')}, {_CAP}
SELECT 'emb_' || (page // 8) AS image_id, page, seed_id, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area, count(*) > any_value(cap) AS leaked FROM gr JOIN pc USING (page) GROUP BY page, seed_id""")
def g7(spark, sf):
    return growth.grow_regions(_seeds(spark, sf), views.float_stack(spark, sf), _planes(spark, sf), tolerance=0.03)


@query("g8_grow_regions_auto", f"""WITH RECURSIVE {_R1M}, {_SEED},
nv AS (SELECT sd.seed_id, list_sort(list(p.value)) AS v FROM sd JOIN r1 p ON p.image_id = sd.image_id AND p.page = sd.page AND abs(p.y - sd.y) <= 4 AND abs(p.x - sd.x) <= 4 GROUP BY ALL),
nu AS (SELECT seed_id, v[len(v) // 2 + 1] AS m, unnest(v) AS e FROM nv),
nd AS (SELECT seed_id, list_sort(list(abs(e - m))) AS d FROM nu GROUP BY ALL),
tl AS MATERIALIZED (SELECT sd.*, CAST(k.i AS INTEGER) AS step, greatest(d[len(d) // 2 + 1] * 1.4826::DOUBLE, 1e-9::DOUBLE) * pow(1.5::DOUBLE, k.i) AS tol, r1.value AS v0
  FROM sd JOIN r1 USING (image_id, page, y, x) JOIN nd USING (seed_id) CROSS JOIN range(14) k(i)),
{_grow_sql('tol')}, {_CAP},
ar AS (SELECT seed_id, step, page, count(*) AS area FROM gr GROUP BY ALL),
lk AS (SELECT *, max(CASE WHEN area > cap THEN 1 ELSE 0 END) OVER (PARTITION BY seed_id ORDER BY step) AS leak FROM ar JOIN pc USING (page)),
cd AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY step) AS k, count(*) OVER (PARTITION BY seed_id) AS n, lead(area) OVER (PARTITION BY seed_id ORDER BY step) AS nx FROM lk WHERE leak = 0),
pk AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY CASE WHEN n <= 2 THEN -k::DOUBLE WHEN area >= 12 AND nx IS NOT NULL THEN (nx - area)::DOUBLE / area ELSE 1e18::DOUBLE END, k) AS rk FROM cd)
SELECT 'emb_' || (sd.page // 8) AS image_id, sd.page, sd.seed_id, pk.step, {rd("tl.tol")} AS tolerance, pk.area FROM sd LEFT JOIN pk ON pk.seed_id = sd.seed_id AND rk = 1 LEFT JOIN tl ON tl.seed_id = pk.seed_id AND tl.step = pk.step""")
def g8(spark, sf):
    return growth.grow_regions_auto(_seeds(spark, sf), views.float_stack(spark, sf), _planes(spark, sf)).withColumn("tolerance", rnd("tolerance"))


def _curve(spark, sf):
    s = views.float_stack(spark, sf)
    rng = s.groupBy(*PLANE).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return O.stability_curve(s, plane_headers(s), rng, samples=16)


def _contracted(rounds: int = 8, doublings: int = 8) -> str:
    """Components of every mask by contraction: each node joins its smallest neighbour, pointers double until they
    stand at a root, and the edges between roots go on. Node: (page * 16 + bin_index) * 4096 + pixel."""
    steps = ["""ed0 AS MATERIALIZED (SELECT a.i, b.i AS j FROM on_ a JOIN on_ b ON b.i = a.i + 1 WHERE b.y = a.y
  UNION ALL SELECT a.i, b.i AS j FROM on_ a JOIN on_ b ON b.i = a.i + 64 WHERE b.y = a.y + 1)"""]
    for k in range(rounds):
        steps.append(f"d{k}_0 AS MATERIALIZED (SELECT i, least(i, min(j)) AS p FROM (SELECT i, j FROM ed{k} UNION ALL SELECT j, i FROM ed{k}) GROUP BY i)")
        steps += [f"d{k}_{m + 1} AS MATERIALIZED (SELECT a.i, b.p FROM d{k}_{m} a JOIN d{k}_{m} b ON a.p = b.i)" for m in range(doublings)]
        last = f"d{k}_{doublings}"
        steps += [f"x{k} AS MATERIALIZED (SELECT d.p AS i, e.j FROM ed{k} e JOIN {last} d ON d.i = e.i)", f"y{k} AS MATERIALIZED (SELECT x.i, d.p AS j FROM x{k} x JOIN {last} d ON d.i = x.j)",
                  f"ed{k + 1} AS MATERIALIZED (SELECT DISTINCT i, j FROM y{k} WHERE i <> j)"]
    gone = " UNION ALL ".join(f"SELECT i FROM d{k}_{doublings} WHERE i <> p" for k in range(rounds))
    return ",\n".join(steps) + f""",
ct AS (SELECT i // 65536 AS page, i // 4096 % 16 AS bin_index, count(*) FILTER (s = 1) AS pixels, sum(s) AS objects FROM (SELECT i, 1 AS s FROM on_ UNION ALL SELECT i, -1 FROM ({gone})) GROUP BY ALL)"""


_CURVE = f"""WITH RECURSIVE {R1}, tp AS (SELECT CAST(i AS INTEGER) AS bin_index, CAST(floor(i / 15.0::DOUBLE * 255 + 0.5) AS INTEGER) AS bin FROM range(16) r(i)),
rg AS (SELECT image_id, page, min(value) AS lo, max(value) AS hi, count(*) AS px FROM r1 GROUP BY ALL),
th AS MATERIALIZED (SELECT image_id, page, px, bin_index, bin, lo + (bin + 1) / 256.0::DOUBLE * (hi - lo) AS value FROM rg CROSS JOIN tp),
on_ AS MATERIALIZED (SELECT (r1.page::BIGINT * 16 + th.bin_index) * 4096 + y * 64 + x AS i, y, x FROM r1 JOIN th ON th.page = r1.page AND r1.value >= th.value),
{_contracted()},
cv AS (SELECT th.image_id, th.page, th.bin_index, bin, value, coalesce(objects, 0) AS object_count, coalesce(pixels, 0)::DOUBLE / px AS area_fraction FROM th LEFT JOIN ct USING (page, bin_index))"""


@query("t14_stability_curve", f"""{_CURVE}
SELECT image_id, page, bin_index, bin, {rd("value")} AS value, object_count, {rd("area_fraction")} AS area_fraction FROM cv""")
def t14(spark, sf):
    c = _curve(spark, sf)[0]
    return c.withColumn("value", rnd("value")).withColumn("area_fraction", rnd("area_fraction"))


@query("t14_suggested_bin", f"""{_CURVE},
ru(page, i, start) AS (SELECT page, 0, 0 FROM rg UNION ALL
  SELECT r.page, r.i + 1, CASE WHEN abs(c.object_count - s.object_count) > greatest(1.0::DOUBLE, s.object_count * 0.1::DOUBLE) THEN r.i + 1 ELSE r.start END
  FROM ru r JOIN cv c ON c.page = r.page AND c.bin_index = r.i + 1 JOIN cv s ON s.page = r.page AND s.bin_index = r.start),
rl AS (SELECT page, start, count(*) AS len FROM ru GROUP BY ALL),
us AS (SELECT rl.*, row_number() OVER (PARTITION BY rl.page ORDER BY len DESC, start) AS rk FROM rl JOIN cv m ON m.page = rl.page AND m.bin_index = start + len // 2
  WHERE m.object_count > 0 AND m.area_fraction > 0.0005::DOUBLE AND m.area_fraction < 0.95::DOUBLE)
SELECT rg.image_id, rg.page, cv.bin AS suggested_bin, CAST(coalesce(len, 0) AS INTEGER) AS plateau_width FROM rg LEFT JOIN us ON us.page = rg.page AND rk = 1
  JOIN cv ON cv.page = rg.page AND cv.bin_index = coalesce(start + len // 2, 8)""")
def t14b(spark, sf):
    return _curve(spark, sf)[1]

"""Normalization, rendering, colormaps, composites, layers, adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from planeweave.functions.numeric import nan_to_null, rnd
from planeweave.operators import display as P
from planeweave.operators import layers as L
from planeweave.operators.stats import image_stats
from planeweave.plans.registry import R1, R2, query, rd
from planeweave.schema import PIXEL, PLANE
from planeweave.sources import views

_BYTE = "CAST(floor(greatest(0, least(1, {v})) * 255 + 0.5) AS INTEGER)"


def _byte(v: str) -> str:
    return _BYTE.format(v=v)


@query("p1_normalization_range", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN -16 ELSE p_size::DOUBLE END WHEN p_partkey % 4 = 1 THEN -16 WHEN p_size < 10 THEN -16
    WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN -16 + p_size / 100.0::DOUBLE * 271 ELSE p_size / 100.0::DOUBLE END AS norm_min,
  round(CASE WHEN p_partkey % 4 = 0 THEN p_retailprice WHEN p_partkey % 4 = 1 THEN 255 WHEN p_size < 10 THEN 255
    WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN -16 + (p_size / 50.0::DOUBLE) * 271 ELSE p_size / 50.0::DOUBLE END, 6) + 0::DOUBLE AS norm_max
FROM part""".replace("CASE WHEN p_partkey % 4 = 0 THEN CASE", "round(CASE WHEN p_partkey % 4 = 0 THEN CASE").replace("END AS norm_min", "END, 6) + 0::DOUBLE AS norm_min"))
def p1(spark, sf):
    p = views.table(spark, sf, "part").select(
        "p_partkey", F.expr("p_partkey % 4 = 0").alias("auto"), F.expr("p_partkey % 4 = 1").alias("gamma_mode"),
        F.expr("if(p_size < 10, null, p_size / 100D)").alias("want_min"), F.expr("if(p_size < 10, null, p_size / 50D)").alias("want_max"),
        F.expr("p_partkey % 3 = 0").alias("normalized"), F.expr("p_partkey % 5 = 0").alias("is_float"),
        F.expr("if(p_partkey % 8 = 0, double('NaN'), cast(p_size as double))").alias("stat_min"), F.col("p_retailprice").alias("stat_max"),
        F.lit(-16.0).alias("type_min"), F.lit(255.0).alias("type_max"))
    return P.normalization_range(p).select("p_partkey", rnd("norm_min").alias("norm_min"), rnd("norm_max").alias("norm_max"))


@query("p2_gamma_exposure", f"""WITH {R1}, n AS (SELECT *, (value + 0.5::DOUBLE) * (1 / 1.0::DOUBLE) AS t FROM r1)
SELECT image_id, page, y, x, CASE WHEN t < 0 THEN 0 ELSE {_byte("pow(pow(t, 2.2::DOUBLE) * pow(2::DOUBLE, 0.5), 1 / 1.8::DOUBLE)")} END AS byte,
       -0.5::DOUBLE AS visible_min, {rd("pow(1 / pow(2::DOUBLE, 0.5), 1 / 2.2::DOUBLE) * 1 - 0.5")} AS visible_max FROM n""")
def p2(spark, sf):
    lo, hi = F.lit(-0.5), F.lit(0.5)
    e0, e1 = P.effective_range(lo, hi, 2.2, 1.8, 0.5)
    return views.float_stack(spark, sf).select(
        *PIXEL, P.to_byte(P.gamma_exposure(P.normalized(F.col("value"), lo, hi), 2.2, 1.8, 0.5)).alias("byte"),
        rnd(e0).alias("visible_min"), rnd(e1).alias("visible_max"))


_RGBA = f"""{R2}, p AS (SELECT image_id, page, y, x, max(CASE WHEN channel = 0 THEN value END) c0, max(CASE WHEN channel = 1 THEN value END) c1, max(CASE WHEN channel = 2 THEN value END) c2 FROM r2 GROUP BY ALL)"""


@query("p3_render_rgba", f"""WITH {_RGBA}, o AS (SELECT *, isfinite(c0) AND isfinite(c1) AND isfinite(c2) AS ok FROM p)
SELECT image_id, page, y, x, CASE WHEN ok THEN {_byte("(c0 - 5) * (1 / 40.0::DOUBLE)")} ELSE 255 END AS r, CASE WHEN ok THEN {_byte("(c1 - 5) * (1 / 40.0::DOUBLE)")} ELSE 0 END AS g,
       CASE WHEN ok THEN {_byte("(c2 - 5) * (1 / 40.0::DOUBLE)")} ELSE 255 END AS b, 255 AS a FROM o""")
def p3(spark, sf):
    s = views.sparse_channels(spark, sf)
    ranges = s.select(*PLANE).distinct().select(*PLANE, F.lit(3).alias("channels"), F.lit(5.0).alias("lo"), F.lit(45.0).alias("hi"))
    return P.render_rgba(s, ranges)


@query("p3_render_gray_alpha", f"""WITH {R2}, p AS (SELECT image_id, page, y, x, max(CASE WHEN channel = 0 THEN value END) c0, max(CASE WHEN channel = 1 THEN value / 50 END) c1 FROM r2 WHERE channel < 2 GROUP BY ALL)
SELECT image_id, page, y, x, CASE WHEN isfinite(c0) THEN {_byte("(c0 - 5) * (1 / 40.0::DOUBLE)")} ELSE 255 END AS r, CASE WHEN isfinite(c0) THEN {_byte("(c0 - 5) * (1 / 40.0::DOUBLE)")} ELSE 0 END AS g,
       CASE WHEN isfinite(c0) THEN {_byte("(c0 - 5) * (1 / 40.0::DOUBLE)")} ELSE 255 END AS b, CASE WHEN isfinite(c0) AND isfinite(c1) THEN {_byte("c1")} ELSE 255 END AS a FROM p""")
def p3b(spark, sf):
    s = views.sparse_channels(spark, sf).where("channel < 2").withColumn("value", F.expr("if(channel = 1, value / 50, value)"))
    ranges = s.select(*PLANE).distinct().select(*PLANE, F.lit(2).alias("channels"), F.lit(5.0).alias("lo"), F.lit(45.0).alias("hi"))
    return P.render_rgba(s, ranges)


def _points_sql(name: str) -> str:
    return str([list(p) for p in P.CONTROL_POINTS[name]])


def _lut_sql(name: str) -> str:
    n = len(P.CONTROL_POINTS[name])
    ch = ", ".join(f"CAST(floor((pts[i0 + 1][{k}]::DOUBLE * (1 - f) + pts[least(i0 + 1, {n - 1}) + 1][{k}]::DOUBLE * f) * 255 + 0.5) AS INTEGER) AS {c}" for k, c in ((1, "cr"), (2, "cg"), (3, "cb")))
    return f"""lut AS MATERIALIZED (SELECT entry, {ch} FROM (SELECT CAST(k.i AS INTEGER) AS entry, CAST(floor((k.i / 255.0::DOUBLE) * {n - 1}) AS INTEGER) AS i0, (k.i / 255.0::DOUBLE) * {n - 1} - floor((k.i / 255.0::DOUBLE) * {n - 1}) AS f, {_points_sql(name)} AS pts FROM range(256) k(i)))"""


def _gray(spark, sf):
    s = views.sparse_channels(spark, sf).where("channel = 0")
    ranges = s.select(*PLANE).distinct().select(*PLANE, F.lit(1).alias("channels"), F.lit(0.0).alias("lo"), F.lit(50.0).alias("hi"))
    return s, P.render_rgba(s, ranges)


@query("p4_apply_colormap", f"""WITH {R2}, {_lut_sql("viridis")},
g AS (SELECT image_id, page, y, x, CASE WHEN isfinite(value) THEN {_byte("value * (1 / 50.0::DOUBLE)")} END AS e FROM r2 WHERE channel = 0)
SELECT image_id, page, y, x, coalesce(cr, 255) AS r, coalesce(cg, 0) AS g, coalesce(cb, 255) AS b, 255 AS a FROM g LEFT JOIN lut ON entry = e""")
def p4(spark, sf):
    s, rgba = _gray(spark, sf)
    return P.apply_colormap(rgba, s, "viridis")


@query("p5_decode_colormap", f"""WITH {R2}, {_lut_sql("magma")},
px AS (SELECT image_id, page, y, x, max(CASE WHEN channel = 0 THEN floor(value * 5) END)::INTEGER r, max(CASE WHEN channel = 1 THEN floor(value * 5) END)::INTEGER g, max(CASE WHEN channel = 2 THEN floor(value * 5) END)::INTEGER b FROM r2 WHERE isfinite(value) GROUP BY ALL),
u AS (SELECT * FROM px WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL),
cells AS (SELECT DISTINCT r // 8 AS ri, g // 8 AS gi, b // 8 AS bi FROM u),
near AS (SELECT ri, gi, bi, entry, row_number() OVER (PARTITION BY ri, gi, bi ORDER BY (ri * (255 / 31.0::DOUBLE) - cr) ** 2 + (gi * (255 / 31.0::DOUBLE) - cg) ** 2 + (bi * (255 / 31.0::DOUBLE) - cb) ** 2, entry) AS rk FROM cells CROSS JOIN lut)
SELECT image_id, page, y, x, r, g, b, {rd("CAST(pow(10::DOUBLE, -1 + (255 - entry) / 255.0::DOUBLE * 4) AS FLOAT)::DOUBLE", 3)} AS value FROM u JOIN near ON ri = r // 8 AND gi = g // 8 AND bi = b // 8 AND rk = 1""")
def p5(spark, sf):
    s = views.sparse_channels(spark, sf)
    v = F.floor(F.col("value") * 5).cast("int")
    rgb = s.where(F.abs("value") < float("inf")).groupBy(*PIXEL).agg(
        *[F.max(F.when(F.col("channel") == i, v)).alias(c) for i, c in enumerate("rgb")]).na.drop(subset=["r", "g", "b"])
    return P.decode_colormap(rgb, "magma", 0.1, 1000.0, inverted=True, logarithmic=True).withColumn("value", rnd("value", 3))


def _tint(k: int) -> str:
    v = {0: (0, 255, 0), 1: (255, 0, 64), 2: (51, 153, 255)}
    body = " ".join(f"WHEN {c} THEN {rgb[k]}" for c, rgb in v.items())
    return f"sum(CASE WHEN t > 0 THEN CAST((CASE channel {body} END) * pow(floor(least(t, 1) * 1023) / 1023.0::DOUBLE, 0.7::DOUBLE) * (1 - channel * 0.25::DOUBLE) AS FLOAT)::DOUBLE ELSE 0 END)"


@query("p6_composite_channels", f"""WITH {R2}, v AS (SELECT *, (value - channel * 5) * (1 / 30.0::DOUBLE) AS t FROM r2 WHERE isfinite(value)),
s AS (SELECT image_id, page, y, x, {_tint(0)} AS r, {_tint(1)} AS g, {_tint(2)} AS b FROM v GROUP BY ALL)
SELECT p.image_id, p.page, p.y, p.x, {", ".join(f"CASE WHEN s.r IS NULL THEN {n} ELSE CAST(round_even(greatest(0, least(255, s.{c})), 0) AS INTEGER) END AS {c}" for c, n in (("r", 9), ("g", 8), ("b", 7)))}
FROM (SELECT DISTINCT image_id, page, y, x FROM r2) p LEFT JOIN s USING (image_id, page, y, x)""")
def p6(spark, sf):
    s = views.sparse_channels(spark, sf)
    settings = spark.range(3).select(F.col("id").cast("int").alias("channel")).select(
        "channel", (F.col("channel") * 5.0).alias("lo"), (F.col("channel") * 5.0 + 30).alias("hi"),
        P.default_colour(F.col("channel"), F.lit("teal")).alias("colour"), (1 - F.col("channel") * 0.25).alias("opacity"),
        F.lit(True).alias("visible"), F.lit(None).cast("string").alias("colormap"))
    return P.composite_channels(s, settings, gamma=0.7, nan_colour=(9, 8, 7))


_PAIR = f"""{R1}, pr AS (SELECT a.image_id, a.page, a.y, a.x, a.value AS below, CASE WHEN a.x = 5 THEN 0 ELSE b.value END AS src FROM r1 a JOIN r1 b ON b.page = a.page + 1 AND b.y = a.y AND b.x = a.x)"""


def _pairs(spark, sf):
    s = views.float_stack(spark, sf)
    up = s.select((F.col("page") - 1).alias("page"), "y", "x", F.expr("if(x = 5, 0D, value)").alias("src"))
    return s.select(*PIXEL, F.col("value").alias("below")).join(up, ["page", "y", "x"])


def _unpivot(df, values: dict):
    return df.select(*PIXEL, *[rnd(nan_to_null(v)).alias(n) for n, v in values.items()])


@query("p7_arithmetic_blends", f"""WITH {_PAIR}
SELECT image_id, page, y, x, {rd("below + src")} AS "add", {rd("below - src")} AS subtract, {rd("abs(below - src)")} AS "raw-difference", {rd("below * src")} AS "raw-multiply",
       CASE WHEN src <> 0 THEN round(below / src, 3) + 0::DOUBLE END AS divide, {rd("least(below, src)")} AS min, {rd("greatest(below, src)")} AS max, {rd("(below + src) * 0.5")} AS average FROM pr""")
def p7(spark, sf):
    v = {m: L.blend_values(F.col("below"), F.col("src"), F.lit(m)) for m in L.ARITHMETIC}
    return _pairs(spark, sf).select(*PIXEL, *[rnd(nan_to_null(c), 3 if m == "divide" else 6).alias(m) for m, c in v.items()])


_DOC = {"multiply": "below * src / 1", "screen": "1 - (1 - below) * (1 - src)", "overlay": "CASE WHEN below <= 0.5 THEN 2 * below * src ELSE 1 - 2 * (1 - below) * (1 - src) END",
        "darken": "least(below, src)", "lighten": "greatest(below, src)", "difference": "abs(below - src)", "exclusion": "below + src - 2 * below * src", "normal": "src"}


@query("p8_document_blends", f"""WITH {_PAIR}
SELECT image_id, page, y, x, {", ".join(f'''{rd(f"(0.6::DOUBLE * 0.8::DOUBLE * below + 0.2::DOUBLE * 0.4::DOUBLE * src + 0.8::DOUBLE * 0.4::DOUBLE * ({e})) / 0.88::DOUBLE")} AS {m}''' for m, e in _DOC.items())} FROM pr""")
def p8(spark, sf):
    v = {m: L.source_over(F.col("below"), F.col("src"), F.lit(m), F.lit(0.4), F.lit(0.8), F.lit(1.0)) for m in L.DOCUMENT}
    return _unpivot(_pairs(spark, sf), v)


def _stack(spark, sf, modes=("normal", "raw-difference", "average")):
    """Three layers per stack: plane p and its two successors, shifted by (k, -k)."""
    s = views.float_stack(spark, sf)
    pages = s.select("page").distinct()
    layers = pages.select(F.col("page").alias("stack_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("layer_order"))
    layers = layers.select(
        "stack_id", "layer_order", F.expr("concat(stack_id, '/', layer_order)").alias("layer_id"), (F.col("stack_id") + F.col("layer_order")).alias("page"),
        F.element_at(F.array(*[F.lit(m) for m in modes]), F.col("layer_order") + 1).alias("mode"), (1 - F.col("layer_order") * 0.25).alias("opacity"),
        F.lit(True).alias("visible"), F.lit(1).alias("channels"), F.lit(1.0).alias("type_max"), F.lit(False).alias("clipped"),
        F.col("layer_order").cast("double").alias("offset_x"), (-F.col("layer_order")).cast("double").alias("offset_y"))
    pixels = layers.select("layer_id", "page").join(s, "page").select("layer_id", "y", "x", F.array("value").alias("values"))
    canvas = pages.select(F.col("page").alias("stack_id"), F.lit(64).alias("canvas_width"), F.lit(64).alias("canvas_height"))
    return layers.drop("page"), pixels, canvas


_L3 = f"""{R1}, st AS (SELECT DISTINCT page AS stack_id FROM r1),
cv AS (SELECT stack_id, CAST(yy.i AS INTEGER) AS y, CAST(xx.i AS INTEGER) AS x FROM st CROSS JOIN range(64) yy(i) CROSS JOIN range(64) xx(i)),
v3 AS (SELECT cv.*, a.value AS a, b.value AS b, c.value AS c FROM cv LEFT JOIN r1 a ON a.page = stack_id AND a.y = cv.y AND a.x = cv.x
   LEFT JOIN r1 b ON b.page = stack_id + 1 AND b.y = cv.y + 1 AND b.x = cv.x - 1 LEFT JOIN r1 c ON c.page = stack_id + 2 AND c.y = cv.y + 2 AND c.x = cv.x - 2)"""


@query("p9_layer_stack", f"""WITH {_L3},
f1 AS (SELECT *, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE a + (abs(a - b) - a) * 0.75::DOUBLE END AS d FROM v3),
f2 AS (SELECT *, CASE WHEN c IS NULL THEN d WHEN d IS NULL THEN c ELSE d + ((d + c) * 0.5 - d) * 0.5 END AS e FROM f1)
SELECT stack_id, y, x, {rd("e")} AS value FROM f2 WHERE e IS NOT NULL""")
def p9(spark, sf):
    out = L.composite_stack(*_stack(spark, sf), ["stack_id"])
    return out.select("stack_id", "y", "x", rnd(F.get("data", 0)).alias("value"))


@query("p9_layer_stack_region", f"""WITH {_L3},
f1 AS (SELECT *, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b ELSE (0.25::DOUBLE * a + 0.75::DOUBLE * (1 - (1 - a) * (1 - b))) END AS d FROM v3 WHERE x BETWEEN 8 AND 39 AND y BETWEEN 4 AND 23),
f2 AS (SELECT *, CASE WHEN c IS NULL THEN d WHEN d IS NULL THEN c WHEN a IS NULL AND b IS NULL THEN c ELSE d END AS e FROM f1)
SELECT stack_id, y, x, {rd("e")} AS value FROM f2 WHERE e IS NOT NULL AND c IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL""")
def p9r(spark, sf):
    layers, pixels, canvas = _stack(spark, sf, ("normal", "screen", "mask"))
    layers = layers.withColumn("cond_op", F.lit("isfinite")).withColumn("cond_value", F.lit(0.0))
    out = L.composite_stack(layers, pixels, canvas, ["stack_id"], region=(8, 4, 32, 20))
    # Only pixels all three layers cover, where the brightness mask (always finite) keeps all.
    full = pixels.join(layers.select("layer_id", "stack_id", "offset_x", "offset_y"), "layer_id").groupBy(
        "stack_id", (F.col("y") + F.col("offset_y")).cast("int").alias("y"), (F.col("x") + F.col("offset_x")).cast("int").alias("x")).count().where("count = 3")
    return out.join(full, ["stack_id", "y", "x"], "left_semi").select("stack_id", "y", "x", rnd(F.get("data", 0)).alias("value"))


@query("p10_layer_tree", f"""WITH {_L3},
s AS (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN c IS NULL THEN b ELSE 0.5 * b + 0.5 * b * c END AS g FROM v3)
SELECT stack_id, y, x, {rd("CASE WHEN g IS NULL THEN a WHEN a IS NULL THEN g ELSE 0.5 * a + 0.5 * (1 - (1 - a) * (1 - g)) END")} AS value,
       {rd("CASE WHEN a IS NULL THEN 0.5::DOUBLE ELSE 1 END")} AS alpha FROM s WHERE a IS NOT NULL OR b IS NOT NULL""")
def p10(spark, sf):
    """The top two layers form a clipped pair inside a half-opaque group above the base."""
    layers, pixels, canvas = _stack(spark, sf, ("normal", "normal", "multiply"))
    group = layers.where("layer_order = 0").withColumn("layer_order", F.lit(9)).withColumn("layer_id", F.expr("concat(stack_id, '/g')")).withColumn(
        "mode", F.lit("screen")).withColumn("opacity", F.lit(0.5)).withColumn("kind", F.lit("group")).withColumn("parent_id", F.lit(None).cast("string"))
    inner = layers.withColumn("kind", F.lit("raster")).withColumn(
        "parent_id", F.expr("if(layer_order = 0, null, concat(stack_id, '/g'))")).withColumn("clipped", F.expr("layer_order = 2"))
    out = L.composite_tree(inner.unionByName(group), pixels, canvas)
    return out.select("stack_id", "y", "x", rnd(nan_to_null(F.get("data", 0))).alias("value"), rnd("alpha").alias("alpha"))


#: Settings of the adjustment layers below.
_SETTINGS = {"invert": {"type": "curves", "rgb": [(0, 255), (255, 0)]}, "lift": {"type": "levels", "rgb": {"shadow_output": 51, "highlight_output": 255}}}


@query("p9_layer_stack_adjusted", f"""WITH {_L3}, mk AS (SELECT page AS stack_id, y + 3 AS y, x + 2 AS x, value FROM r1),
w AS (SELECT v3.*, CASE WHEN m.value IS NULL THEN 0 ELSE greatest(0, least(1, m.value / 0.5)) END AS f FROM v3 LEFT JOIN mk m USING (stack_id, y, x)),
sb AS (SELECT *, CASE WHEN b IS NOT NULL THEN greatest(0, least(1, b)) END AS bu FROM w),
i1 AS (SELECT *, b + ((0.2::DOUBLE + bu * 0.8::DOUBLE) - b) * 0.5::DOUBLE AS bs, greatest(0, least(1, a)) AS au FROM sb),
i2 AS (SELECT *, a + ((1 - au) - a) * (0.8::DOUBLE * f) AS am FROM i1),
i3 AS (SELECT *, CASE WHEN b IS NULL THEN am WHEN a IS NULL THEN bs ELSE am * 0.25::DOUBLE + bs * 0.75::DOUBLE END AS d FROM i2),
i4 AS (SELECT *, CASE WHEN c IS NULL THEN d WHEN d IS NULL THEN c ELSE d + (d * c - d) * 0.5 END AS e FROM i3)
SELECT stack_id, y, x, {rd("e", 5)} AS value FROM i4 WHERE e IS NOT NULL""")
def p9a(spark, sf):
    """Base, masked inversion, a layer with a clipped lift, and a multiplied layer on top."""
    layers, pixels, canvas = _stack(spark, sf, ("normal", "normal", "raw-multiply"))
    layers = layers.withColumn("setting", F.lit(None).cast("string")).withColumn("layer_order", F.col("layer_order") * 10)

    def adjustment(order, name, opacity, clipped):
        return layers.where("layer_order = 0").withColumns({
            "layer_order": F.lit(order), "layer_id": F.concat_ws("/", "stack_id", F.lit(name)), "setting": F.lit(name), "opacity": F.lit(opacity),
            "clipped": F.lit(clipped), "mode": F.lit("normal")})

    every = layers.unionByName(adjustment(5, "invert", 0.8, False)).unionByName(adjustment(15, "lift", 0.5, True))
    masks = every.where("setting = 'invert'").select("layer_id", F.col("stack_id").alias("mask_id"), F.lit(False).alias("invert"), F.lit(0.5).alias("mask_max"),
                                                     F.lit(2).alias("mask_x"), F.lit(3).alias("mask_y"))
    mpx = views.float_stack(spark, sf).select(F.col("page").alias("mask_id"), "y", "x", "value")
    out = L.composite_clipped(every, pixels, canvas, ["stack_id"], masks, mpx, _SETTINGS)
    return out.select("stack_id", "y", "x", rnd(F.get("data", 0), 5).alias("value"))


@query("p11_raster_mask", f"""WITH {_L3}, mk AS (SELECT page AS stack_id, y + 3 AS y, x + 2 AS x, value FROM r1),
w AS (SELECT v3.*, CASE WHEN m.value IS NULL THEN 1 ELSE 1 - greatest(0, least(1, m.value / 0.5)) END AS f FROM v3 LEFT JOIN mk m USING (stack_id, y, x))
SELECT stack_id, y, x, {rd("CASE WHEN b IS NULL OR f * 0.75::DOUBLE <= 0 THEN a WHEN a IS NULL THEN b ELSE a + (abs(a - b) - a) * (0.75::DOUBLE * f) END")} AS value, {rd("f")} AS factor
FROM w WHERE (a IS NOT NULL OR (b IS NOT NULL AND f > 0)) AND b IS NOT NULL""")
def p11(spark, sf):
    layers, pixels, canvas = _stack(spark, sf, ("normal", "raw-difference", "mask"))
    layers = layers.where("layer_order < 2")
    masks = layers.where("layer_order = 1").select("layer_id", F.col("stack_id").alias("mask_id"), F.lit(True).alias("invert"), F.lit(0.5).alias("mask_max"),
                                                   F.lit(2).alias("mask_x"), F.lit(3).alias("mask_y"))
    mpx = views.float_stack(spark, sf).select(F.col("page").alias("mask_id"), "y", "x", "value")
    v = L.visible_layers(layers)
    placed = L.mask_factor(L.place(v, pixels, canvas, ["stack_id"]), masks, mpx)
    out = L.fold_stack(placed, L.output_channels(v, ["stack_id"]), ["stack_id"]).where("alpha > 0")
    f = placed.where("layer_order = 1").select("stack_id", "y", "x", "factor")
    return out.join(f, ["stack_id", "y", "x"]).select("stack_id", "y", "x", rnd(F.get("data", 0)).alias("value"), rnd("factor").alias("factor"))


_RGB = f"""{R2}, u AS (SELECT image_id, page, y, x, max(CASE WHEN channel = 0 THEN value / 50 END) r, max(CASE WHEN channel = 1 THEN value / 50 END) g, max(CASE WHEN channel = 2 THEN value / 50 END) b FROM r2 WHERE isfinite(value) GROUP BY ALL),
q AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM u WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)"""


def _rgb(spark, sf):
    s = views.covered_channels(spark, sf)
    return s.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("channel") == i, F.col("value") / 50)).alias(c) for i, c in enumerate("rgb")]).na.drop(subset=["r", "g", "b"])


def _adj_sql(kind: str, *exprs: str) -> str:
    return f"SELECT '{kind}' AS kind, image_id, page, y, x, " + ", ".join(
        rd(f"{c} + (greatest(0, least(1, {e})) - {c}) * 0.8::DOUBLE", 5) + f" AS {c}" for c, e in zip("rgb", exprs)) + " FROM q"


_ADJ = {
    "brightness/contrast": ({"brightness": 10, "contrast": 30}, tuple(f"(({c} - 0.5) * (1.3::DOUBLE / 0.7::DOUBLE) + 0.5 + 0.1::DOUBLE)" for c in "rgb")),
    "exposure": ({"exposure": 0.5, "offset": -0.05, "gamma": 1.5}, tuple(f"pow(greatest(0, {c} * pow(2::DOUBLE, 0.5) - 0.05::DOUBLE), 1 / 1.5::DOUBLE)" for c in "rgb")),
    "invert": ({}, tuple(f"1 - {c}" for c in "rgb")),
    "channel mixer": ({"monochrome": True, "gray": {"red": 30, "green": 50, "blue": 10, "constant": 5}}, ("r * 0.3::DOUBLE + g * 0.5::DOUBLE + b * 0.1::DOUBLE + 0.05::DOUBLE",) * 3),
    "threshold": ({"level": 120}, ("CASE WHEN l * 255 >= 120 THEN 1 ELSE 0 END",) * 3),
    "posterize": ({"levels": 5}, tuple(f"floor({c} * 4 + 0.5) / 4" for c in "rgb")),
    "gradient map": ({"stops": [(0, (10, 20, 30)), (0.5, (200, 100, 50)), (1, (255, 255, 0))]}, tuple(
        f"(CASE WHEN l <= 0.5 THEN {a} + ({b} - {a}) * l / 0.5 ELSE {b} + ({c} - {b}) * (l - 0.5) / 0.5 END) / 255.0::DOUBLE" for a, b, c in ((10, 200, 255), (20, 100, 255), (30, 50, 0)))),
}
_LEVEL = "(20 + pow(greatest(0, least(1, ({i} - 30) / 200.0::DOUBLE)), 1 / 1.4::DOUBLE) * 210) / 255.0::DOUBLE"
_ADJ["levels"] = ({"rgb": {"shadow_input": 30, "highlight_input": 230, "midtone": 1.4, "shadow_output": 20, "highlight_output": 230}}, tuple(
    f"({_LEVEL.format(i=f'floor({c} * 255)')} + ({_LEVEL.format(i=f'least(255, floor({c} * 255) + 1)')} - {_LEVEL.format(i=f'floor({c} * 255)')}) * ({c} * 255 - floor({c} * 255)))" for c in "rgb"))


@query("p12_adjustments", f"WITH {_RGB} " + " UNION ALL ".join(_adj_sql(k, *e) for k, (_, e) in _ADJ.items()))
def p12(spark, sf):
    rgb, out = _rgb(spark, sf), None
    for kind, (params, _) in _ADJ.items():
        one = L.adjust(rgb, {"type": kind, **params}, amount=0.8).select(
            F.lit(kind).alias("kind"), *PIXEL, *[rnd(c, 5).alias(c) for c in "rgb"])
        out = one if out is None else out.unionByName(one)
    return out


@query("p12_colour_adjustments")
def p12c(spark, sf):
    rgb, out = _rgb(spark, sf), None
    for a in ({"type": "hue/saturation", "master": {"hue": 20, "saturation": 10}, "reds": {"hue": -15, "a": 330, "b": 350, "c": 10, "d": 30}},
              {"type": "color balance", "shadows": {"cyan_red": 20}, "midtones": {"magenta_green": -10}, "preserve_luminosity": True},
              {"type": "black & white", "reds": 70}, {"type": "curves", "rgb": [(0, 0), (64, 40), (192, 220), (255, 255)]}):
        one = L.adjust(rgb, a).select(F.lit(a["type"]).alias("kind"), *PIXEL, *[rnd(c, 5).alias(c) for c in "rgb"])
        out = one if out is None else out.unionByName(one)
    return out

"""Planted inputs with known answers."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import disc, raster
from planeweave.functions import derived, text, values
from planeweave.operators import components, datasets, demosaic, display, layers, neighbourhood, objects, rois, stats, thresholds
from planeweave.schema import PIXEL, PLANE
from planeweave.sources import raster_files, tables
from planeweave.streaming import incremental

NAN = float("nan")


def grid_of(df, h, w, col="value"):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[col]
    return out


def mask(spark, rows, page=0):
    return spark.createDataFrame([("i", page, y, x) for y, line in enumerate(rows) for x, c in enumerate(line) if c == "#"],
                                 "image_id string, page int, y int, x int")


# --- values and statistics ------------------------------------------------------------------


def test_rescale_and_fill(spark):
    d = spark.createDataFrame([(300.0,), (-32768.0,), (-100.0,)], "s double")
    got = [r.v for r in d.select(values.rescale("s", 2.5, 100.0, [-32768.0]).alias("v")).collect()]
    assert got[0] == 850 and math.isnan(got[1]) and got[2] == -150


def test_image_stats_ignore_alpha_and_nan(spark):
    s = raster(spark, [[1, 2], [3, NAN]]).unionByName(raster(spark, [[900, 900], [900, 900]], channel=1))
    r = stats.image_stats(s).first()
    assert (r["min"], r["max"], r["mean"], r["valid_count"], r["non_finite_count"], r["total_count"]) == (1, 3, 2, 3, 1, 4)
    assert r["std"] == pytest.approx(math.sqrt(2 / 3))


def test_histogram_constant_and_empty(spark):
    h = stats.histogram(raster(spark, [[7, 7], [7, NAN]])).collect()
    assert [(r["bin"], r["n"]) for r in h] == [(0, 3)]
    e = stats.histogram_header(raster(spark, [[NAN, NAN]])).first()
    assert (e["min"], e["max"], e["total"], e["non_finite_count"]) == (0, 0, 0, 2)


def test_constant_auto_range(spark):
    r = stats.auto_range(raster(spark, [[0, 0]])).first()
    assert (r["lo"], r["hi"]) == (0, 1)


# --- thresholds -----------------------------------------------------------------------------


@pytest.mark.parametrize("method", thresholds.METHODS)
def test_every_method_on_a_disc(spark, method):
    g = [[v + (x * 7 + y * 3) % 11 for x, v in enumerate(line)] for y, line in enumerate(disc(96, 96, [(48, 48, 25)], 180, 30))]
    r = thresholds.auto_threshold(stats.histogram(raster(spark, g)), method).first()
    assert r["threshold_bin"] == -1 or 30 <= r["threshold"] <= 200
    if method == "otsu":
        assert 40 < r["threshold"] <= 181


def test_huang_beats_first_bin(spark):
    counts = np.zeros(256, dtype=np.int64)
    counts[10:60] = 20
    counts[180:230] = 20
    assert 50 <= thresholds._huang(counts) < 190


def test_shanbhag_matches_its_definition():
    rng = np.random.default_rng(3)
    c = rng.integers(0, 40, 256)
    p, cum = c / c.sum(), np.cumsum(c / c.sum())
    best, gap = -1, math.inf
    for t in range(256):
        pb, pf = cum[t], 1 - cum[t]
        if pb <= 0 or pf <= 0:
            continue
        back, run = 0.0, 1.0
        for i in range(1, t + 1):
            run *= (pb - p[t - i + 1]) / pb
            if not run > 0:
                break
            back -= p[i] * math.log(run)
        fore, run = 0.0, 1.0
        for j in range(1, 256 - t):
            run *= (pf - p[t + j]) / pf
            if not run > 0:
                break
            fore -= p[t + j] * math.log(run)
        if abs(back / pb - fore / pf) < gap:
            best, gap = t, abs(back / pb - fore / pf)
    assert thresholds._shanbhag(c) == best


def test_stability_plateau_on_a_disc(spark):
    s = raster(spark, disc(64, 64, [(32, 32, 15)]))
    head = s.groupBy(*PLANE).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    curve, pick = objects.stability_curve(s, stats.plane_headers(s), head, samples=48)
    rows = curve.orderBy("bin_index").collect()
    p = pick.first()
    assert len(rows) == 48 and p["plateau_width"] > 3
    assert 20 < 20 + (p["suggested_bin"] + 1) / 256 * 180 < 200


# --- neighbourhood ----------------------------------------------------------------------------


def test_blur_keeps_mass_and_ignores_nan(spark):
    g = np.zeros((15, 15))
    g[7, 7] = 1
    out = grid_of(neighbourhood.gaussian_blur(raster(spark, g), 1.0), 15, 15)
    assert out.sum() == pytest.approx(1, abs=1e-5)
    g[:] = 5
    g[3, 3] = NAN
    out = grid_of(neighbourhood.gaussian_blur(raster(spark, g), 1.0), 15, 15)
    assert np.allclose(out, 5)
    same = raster(spark, g)
    assert neighbourhood.gaussian_blur(same, 0) is same


def test_background_subtraction_flattens_a_ramp(spark):
    g = [[x * 1.0 for x in range(20)] for _ in range(9)]
    out = grid_of(neighbourhood.subtract_background(raster(spark, g), 2), 9, 20)
    assert np.allclose(out[:, 3:-3], 0)


def test_distance_transform(spark):
    rows = ["......", ".####.", ".####.", ".####.", "......"]
    m = mask(spark, rows)
    planes = spark.createDataFrame([("i", 0, 6, 5)], "image_id string, page int, width int, height int")
    out = grid_of(neighbourhood.distance_transform(m, planes), 5, 6, "d2")
    want = [[min((y - b) ** 2 + (x - a) ** 2 for b in range(5) for a in range(6) if rows[b][a] == ".") for x in range(6)] for y in range(5)]
    assert np.array_equal(out, np.array(want, dtype=float))


@pytest.mark.parametrize("tile", [4, 16, 64])
def test_local_median_is_tile_invariant(spark, tile):
    rng = np.random.default_rng(1)
    g = rng.normal(size=(20, 23))
    s = raster(spark, g)
    got = {(r.y, r.x) for r in neighbourhood.local_median(s, 2, 0.1, dark_background=False, tile=tile).collect()}
    lo, hi = g.min(), g.max()
    bins = np.clip(np.floor((g - lo) * (64 / (hi - lo))), 0, 63)
    want = set()
    for y in range(20):
        for x in range(23):
            w = np.sort(bins[max(0, y - 2):y + 3, max(0, x - 2):x + 3].ravel())
            if g[y, x] <= lo + (w[(len(w) + 1) // 2 - 1] + 0.5) / (64 / (hi - lo)) - 0.1:
                want.add((y, x))
    assert got == want


def test_demosaic_of_flat_colour(spark):
    colour = (0.2, 0.5, 0.8)
    for pattern in ("rggb", "xtrans", "quad_rggb"):
        period, cells, _ = demosaic.layout(pattern)
        g = [[colour[cells[(y % period) * period + x % period]] for x in range(12)] for y in range(12)]
        for algorithm in ("nearest", "bilinear", "malvar"):
            out = demosaic.demosaic(raster(spark, g), pattern, algorithm)
            worst = out.select(F.max(F.abs(F.col("value") - F.element_at(F.array(*[F.lit(c) for c in colour]), F.col("channel") + 1)))).first()[0]
            assert worst < 1e-9, (pattern, algorithm)


# --- components and objects -------------------------------------------------------------------


@pytest.mark.parametrize("tile", [3, 16, 64])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_are_tile_invariant(spark, tile, connectivity):
    rng = np.random.default_rng(7)
    on = rng.random((40, 37)) < 0.55
    on[20, :] = True
    rows = ["".join("#" if v else "." for v in line) for line in on]
    got = {(r.y, r.x): r.label for r in components.label_components(mask(spark, rows), connectivity, tile).collect()}
    want, nxt = {}, 0
    for y in range(40):
        for x in range(37):
            if on[y, x] and (y, x) not in want:
                nxt += 1
                todo = [(y, x)]
                want[y, x] = nxt
                while todo:
                    b, a = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            q = (b + dy, a + dx)
                            if (connectivity == 8 or abs(dy) + abs(dx) == 1) and 0 <= q[0] < 40 and 0 <= q[1] < 37 and on[q] and q not in want:
                                want[q] = nxt
                                todo.append(q)
    assert got == want


def test_diagonal_pixels(spark):
    m = mask(spark, ["#.", ".#"])
    assert components.label_components(m, 8).select("label").distinct().count() == 1
    assert components.label_components(m, 4).select("label").distinct().count() == 2
    assert components.count_components(m, 4, PLANE).first()["object_count"] == 2


def test_long_chain_contracts(spark):
    e = spark.range(1, 200).select(F.lit("i").alias("image_id"), F.lit(0).alias("page"), (F.col("id") * 7919 % 997).alias("u"), ((F.col("id") + 1) * 7919 % 997).alias("v"))
    e = e.select(*PLANE, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    out = components.contract(e, PLANE)
    assert out.select("v").distinct().count() == 1 and out.count() == 199


def test_two_discs_split_by_shape(spark):
    s = raster(spark, disc(120, 80, [(45, 40, 25), (75, 40, 25)])).where("value > 100").select(*PIXEL)
    planes = spark.createDataFrame([("i", 0, 120, 80)], "image_id string, page int, width int, height int")
    assert components.label_components(s).select("label").distinct().count() == 1
    split = objects.split_by_shape(s, planes)
    assert components.label_components(split).select("label").distinct().count() == 2


def _basins(pixels, tolerance):
    """Basins by steepest ascent, merged saddle by saddle from the highest, one after the other."""
    lo, hi = min(pixels.values()), max(pixels.values())
    rank = {p: (math.floor((v - lo) * (4095.0 / (hi - lo)) + 0.5), -p[0], -p[1]) for p, v in pixels.items()}
    near = lambda p: [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (p[0] + dy, p[1] + dx) in pixels]

    def top(p):
        best = max([p, *near(p)], key=rank.get)
        return p if best == p else top(best)

    tops = {p: top(p) for p in pixels}
    saddle = {}
    for p in pixels:
        for q in near(p):
            if rank[tops[p]] < rank[tops[q]]:
                k = (tops[p], tops[q])
                saddle[k] = max(saddle.get(k, -math.inf), min(pixels[p], pixels[q]))
    boss = {t: t for t in tops.values()}
    for (a, b), s in sorted(saddle.items(), key=lambda e: (e[1], rank[e[0][0]], rank[e[0][1]]), reverse=True):
        x, y = boss[a], boss[b]
        if x != y and min(pixels[x], pixels[y]) - s <= tolerance:
            keep, lose = (x, y) if (pixels[x], rank[x]) > (pixels[y], rank[y]) else (y, x)
            boss = {t: keep if r == lose else r for t, r in boss.items()}
    return {p: None if any(boss[tops[q]] != boss[tops[p]] and rank[q] > rank[p] for q in near(p)) else boss[tops[p]] for p in pixels}


@pytest.mark.parametrize("tolerance, in_one_call", [(0.15, 50_000), (0.3, 0)])
def test_watershed_against_one_saddle_at_a_time(spark, monkeypatch, tolerance, in_one_call):
    monkeypatch.setattr(objects, "SADDLES_PER_CALL", in_one_call)
    rng = np.random.default_rng(11)
    grid = np.round(rng.random((9, 10)), 3)
    s = raster(spark, grid.tolist())
    mask_px = s.select(*PIXEL)
    got = {(r.y, r.x): r.basin for r in objects.watershed(mask_px, s.select(*PIXEL, F.col("value").alias("height")), tolerance).collect()}
    want = _basins({(y, x): float(grid[y, x]) for y in range(9) for x in range(10)}, tolerance)
    assert {p for p, b in got.items() if b == 0} == {p for p, b in want.items() if b is None}
    assert len({(got[p], want[p]) for p in got if got[p]}) == len({b for b in got.values() if b}) == len({b for b in want.values() if b})


def test_hole_is_filled_and_bay_is_not(spark):
    rows = [".......", ".#####.", ".#...#.", ".#.#.#.", ".#...#.", ".#####.", ".......", ".#####.", ".#...#.", ".#.###.", "......."]
    labels = components.label_components(mask(spark, rows), 8)
    out = objects.fill_holes(labels)
    ring = out.where("label = 1").count()
    bay = out.where("label = 3").count()
    assert ring == 25 and bay == 5 + 2 + 4


def test_run_length_round_trip(spark):
    m = mask(spark, ["..##.", "#####", "...#."]).withColumn("obj", F.lit(1))
    enc = tables.encode_runs(m, ["obj"])
    assert enc.first()["runs"] == [2, 2, 1, 5, 3, 1, 1]
    back = {(r.y, r.x) for r in tables.decode_runs(enc, ["obj"]).collect()}
    assert back == {(r.y, r.x) for r in m.collect()}


# --- ROIs -------------------------------------------------------------------------------------

ROI = ("roi_id bigint, image_id string, page int, kind string, x double, y double, width double, height double, angle double, "
       "line_width int, points array<double>")


def roi(spark, *rows):
    return spark.createDataFrame([(i, "i", 0, k, x, y, w, h, 0.0, 1, p) for i, (k, x, y, w, h, p) in enumerate(rows)], ROI)


def planes_of(spark, w, h):
    return spark.createDataFrame([("i", 0, 1, w, h)], "image_id string, page int, channels int, width int, height int")


def test_rasterised_areas(spark):
    r = roi(spark, ("rect", 10.0, 20.0, 30.0, 40.0, None), ("rect", 90.0, 90.0, 50.0, 50.0, None), ("ellipse", 0.0, 0.0, 100.0, 60.0, None),
            ("polygon", 0.0, 0.0, 0.0, 0.0, [10.0, 10.0, 20.0, 10.0, 20.0, 30.0, 10.0, 30.0]), ("polygon", 0.0, 0.0, 0.0, 0.0, [20.0, 10.0, 33.0, 10.0, 33.0, 30.0, 20.0, 30.0]))
    s = rois.rasterize(r, planes_of(spark, 100, 100))
    n = {x["roi_id"]: x["n"] for x in s.groupBy("roi_id").agg(F.sum(F.col("x_end") - F.col("x_start") + 1).alias("n")).collect()}
    assert n[0] == 1200 and n[1] == 100 and abs(n[2] - math.pi * 50 * 30) < 50
    assert n[3] == 200 and n[4] == 260
    shape = {x["roi_id"]: x for x in rois.span_shape(s).collect()}
    assert shape[2]["major"] == pytest.approx(100, rel=0.02) and shape[2]["minor"] == pytest.approx(60, rel=0.02)


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_median_of_large_and_small_keys(spark, accuracy):
    """Brackets that hold a part of a key's values, or all; ties, an outlier, even and odd counts."""
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=3001)] + [("b", float(v)) for v in rng.integers(0, 4, 500)] + [("c", 1.0), ("c", 4.0), ("d", 2.0)]
    rows += [("e", float(v)) for v in rng.exponential(size=2000)] + [("e", 1e30)]
    d = spark.createDataFrame([*rows, ("a", float("nan")), ("n", float("inf"))], "k string, value double").repartition(5)
    got = {r.k: r["median"] for r in rois.exact_median(d, ["k"], accuracy=accuracy).collect()}
    assert sorted(got) == list("abcde")
    for k in got:
        assert got[k] == np.median([v for n, v in rows if n == k])


def test_disc_contour_is_round(spark):
    s = raster(spark, disc(60, 60, [(30, 30, 20)])).where("value > 100").select(*PIXEL).withColumn("label", F.lit(1))
    c = rois.mask_contours(s, [*PLANE, "label"]).first()
    area = s.count()
    assert 0.9 < 4 * math.pi * area / c["perimeter"] ** 2 < 1.1


@pytest.mark.parametrize("rows, contour", [
    (["#"], [(0, 0)]), (["##"], [(0, 0), (1, 0)]), (["#.", ".#"], [(0, 0), (1, 1)]),
    (["###", "#.#", "###"], [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]),
    (["##..#", "##..#"], [(0, 0), (1, 0), (1, 1), (0, 1)]), (["..#", "##.", "..#"], [(2, 0), (1, 1), (2, 2), (1, 1), (0, 1), (1, 1)]),
])
def test_contours_of_small_masks(spark, rows, contour):
    got = rois.mask_contours(mask(spark, rows).withColumn("label", F.lit(1)), [*PLANE, "label"]).first()
    assert list(zip(got["contour"][::2], got["contour"][1::2])) == contour
    turn = [(a, b) for a, b in zip(contour, contour[1:] + contour[:1]) if len(contour) > 1]
    assert got["perimeter"] == pytest.approx(sum(1.34 if a[0] != b[0] and a[1] != b[1] else 0.948 for a, b in turn))


def test_feret_of_a_rectangle():
    hull, f, _, m, *_ = rois._feret([0, 0, 4, 0, 4, 3, 0, 3, 2, 1], 1.0, 1.0)
    assert (f, m, len(hull)) == (5.0, 3.0, 8)


# --- display and layers -------------------------------------------------------------------------


def test_channel_composite_adds_and_saturates(spark):
    s = raster(spark, [[0, 50, 100]]).unionByName(raster(spark, [[NAN, 0, 100]], channel=1))
    settings = spark.createDataFrame([(0, 0.0, 100.0, "#00ff00", 1.0, True, None), (1, 0.0, 100.0, "#ff0000", 1.0, True, None)],
                                     "channel int, lo double, hi double, colour string, opacity double, visible boolean, colormap string")
    got = {r.x: (r.r, r.g, r.b) for r in display.composite_channels(s, settings).collect()}
    assert got[0] == (0, 0, 0) and got[1][1] in (127, 128) and got[2] == (255, 255, 0)
    gray = display.composite_channels(s, settings.withColumn("colormap", F.lit("gray")), solo=0).collect()
    assert {r.x: r.r for r in gray}[2] == 255


def test_colormap_round_trip(spark):
    for name in display.COLORMAPS:
        table = display.colormap(name)
        assert table.shape == (256, 3) and table.min() >= 0 and table.max() <= 255
    d = spark.createDataFrame([(i, *map(int, display.colormap("viridis")[i])) for i in range(256)], "i int, r int, g int, b int")
    worst = display.decode_colormap(d, "viridis", 0.0, 255.0).select(F.max(F.abs(F.col("value") - F.col("i")))).first()[0]
    assert worst <= 12


def stack(spark, modes, values_, channels=1, top=1.0, **extra):
    n = len(modes)
    lay = spark.createDataFrame([("s", i, f"l{i}", m, float(extra.get("opacity", [1.0] * n)[i]), True, channels, top, bool(extra.get("clipped", [False] * n)[i]), 0.0, 0.0,
                                  extra.get("kind", ["raster"] * n)[i], extra.get("parent", [None] * n)[i]) for i, m in enumerate(modes)],
                                "stack_id string, layer_order int, layer_id string, mode string, opacity double, visible boolean, channels int, type_max double, "
                                "clipped boolean, offset_x double, offset_y double, kind string, parent_id string")
    px = spark.createDataFrame([(f"l{i}", 0, x, v if isinstance(v, list) else [float(v)]) for i, line in enumerate(values_) for x, v in enumerate(line)],
                               "layer_id string, y int, x int, values array<double>")
    canvas = spark.createDataFrame([("s", 16, 1)], "stack_id string, canvas_width int, canvas_height int")
    return lay, px, canvas


def test_subtract_layers_and_nan(spark):
    out = layers.composite_stack(*stack(spark, ["normal", "subtract"], [[10, 20, 30, NAN], [1, 2, 3, 4]]), ["stack_id"])
    got = {r.x: r.data[0] for r in out.collect()}
    assert (got[0], got[1], got[2]) == (9, 18, 27) and math.isnan(got[3])
    out = layers.composite_stack(*stack(spark, ["normal", "normal"], [[10, NAN], [NAN, 5]], opacity=[1, 0.5]), ["stack_id"])
    assert all(math.isnan(r.data[0]) for r in out.collect())


def test_rgba_source_over(spark):
    out = layers.composite_stack(*stack(spark, ["normal", "multiply"], [[[1.0, 0.5, 0.0, 1.0]], [[0.5, 0.5, 0.5, 0.5]]], channels=4), ["stack_id"]).first()
    assert out.data == pytest.approx([0.75, 0.375, 0.0, 1.0]) and out.alpha == 1


def test_group_opacity_and_clipping(spark):
    args = stack(spark, ["normal", "normal", "normal", "normal"], [[0, 0, 0], [1, 1], [], [0.5, 0.5, 0.5]], opacity=[1, 1, 0.5, 1],
                 kind=["raster", "raster", "group", "raster"], parent=[None, "l2", None, "l2"], clipped=[False, False, False, True])
    got = {r.x: r.data[0] for r in layers.composite_tree(*args).collect()}
    # The clipped layer replaces its base only where the base covers; the group is half opaque.
    assert got == {0: pytest.approx(0.25), 1: pytest.approx(0.25), 2: pytest.approx(0.0)}


def test_hue_shift_matches_colorsys(spark):
    import colorsys
    rng = np.random.default_rng(2)
    cols = [tuple(map(float, c)) for c in rng.random((40, 3))]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cols)], "i int, r double, g double, b double")
    got = {r.i: (r.r, r.g, r.b) for r in layers.adjust(d, {"type": "hue/saturation", "master": {"hue": 40}}).collect()}
    for i, c in enumerate(cols):
        h, l, s = colorsys.rgb_to_hls(*c)
        assert got[i] == pytest.approx(colorsys.hls_to_rgb((h + 40 / 360) % 1, l, s), abs=1e-9)


def test_curve_is_monotone():
    pts = [(0, 0), (64, 40), (192, 220), (255, 255)]
    ys = [layers.curve_value(pts, x) for x in range(256)]
    assert ys[0] == 0 and ys[64] == pytest.approx(40) and ys[255] == 255
    assert all(b >= a - 1e-9 for a, b in zip(ys, ys[1:]))


# --- text, tables, files, streams -----------------------------------------------------------------


def test_expressions(spark):
    d = spark.createDataFrame([(3.0, 4.0, None, "t")], "a double, b double, c double, s string")
    for t, want in {"2+3*4": 14, "-2^2": 4, "2^3^2": 512, "(a^2+b^2)^0.5": 5, "max(a,b)": 4, "min(a, c)": NAN, "round(-0.5)": 0, "round(2.5)": 3, "7 % 4": 3,
                    "1/0": math.inf, "0/0": NAN, "log(0)": -math.inf, "nope": NAN, "s": NAN, "pi": math.pi, "2*-3": -6, "1e-3*1000": 1, "sign(-a)": -1, "-(2^2)": -4}.items():
        got = derived.with_derived(d, "out", t).first()["out"]
        assert (math.isnan(got) if math.isnan(want) else got == pytest.approx(want)), t
    for bad, at in (("1 + ", 4), ("a $ b", 2), ("foo(a)", 0), ("(1", None), ("a ** b", 3), ("1.2.3", 0)):
        with pytest.raises(derived.ExpressionError) as err:
            derived.compile_expression(bad, {"a"})
        assert at is None or err.value.position == at, bad
    assert derived.dependencies("a*b + pi - sqrt(area.mean)") == ["a", "b", "area.mean"]
    assert derived.dependencies("a +") == []


def test_names(spark):
    assert text.pattern_to_regex("{a") is None and text.pattern_to_regex("{}_x") is None
    d = spark.createDataFrame([("/p/ctrl_1_x.tif",), ("/p/other.tif",)], "path string")
    got = text.match_name_pattern(d, "path", "{cond}_{rep}_*.tif").collect()
    assert (got[0].cond, got[0].rep, got[1].cond) == ("ctrl", "1", None)
    names = spark.createDataFrame([("im10",), ("im9",), ("IM1",)], "n string")
    assert [r.n for r in names.orderBy(text.natural_key("n")).collect()] == ["IM1", "im9", "im10"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranks_over_range_partitions(spark, partitions):
    """Groups over many partitions, ties that partitions split, nulls, NaN and an empty table."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(v), i) for i, v in enumerate(rng.integers(0, 9, 300))] + [("b", 5.0, 0), ("b", None, 1), ("b", 1.0, 2), ("b", 1.0, 3), ("b", float("nan"), 4), (None, 2.0, 0)]
    d = spark.createDataFrame(rows, "k string, v double, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {(r.k, r.i): r.rk for r in datasets.ranked(d, ["k"], ["v"], "rk", ["i"]).collect()}
        assert datasets.ranked(d.where("i < 0"), ["k"], ["v"], "rk").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spot = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    for k, v, i in rows:
        assert got[k, i] == len({spot(w) for o, w, _ in rows if o == k and spot(w) < spot(v)}), (k, v)
    assert len(got) == len(rows)


def test_series_axes_and_unnumbered_images(spark):
    head = "path string, has_pixels boolean, sop_uid string, series_uid string, study_uid string, series_number int, frame_of_reference string, rows int, columns int, position array<double>, orientation array<double>, instance_number int, t int, echo int, frames int"
    rows = [("/a/im2.dcm", True, "1", "s", "", None, None, 4, 4, None, None, None, 0, None, 1), ("/b/im2.dcm", True, "2", "s", "", None, None, 4, 4, None, None, None, 0, None, 1),
            ("/a/im1.dcm", True, "3", "s", "", None, None, 4, 4, None, None, 7, 0, None, 1), ("/c/im1.dcm", True, "4", "s", "", None, None, 4, 4, None, None, 7, 0, None, 1),
            ("/a/im9.dcm", True, "5", "s", "", None, None, 4, 4, None, None, 1, 3, None, 1), ("/a/one.dcm", True, "6", "f", "", None, None, 4, 4, None, None, 1, None, None, 5),
            ("/a/no.dcm", False, "7", "f", "", None, None, 4, 4, None, None, 1, None, None, 5)]
    h = spark.createDataFrame(rows, head)
    z = {r.path: r.coordinates for r in datasets.assemble_series(h).where("frame_index = 0").collect()}
    # Numbered images share a slice with their number; unnumbered ones follow, each by itself.
    assert z["/a/im1.dcm"]["z"] == z["/c/im1.dcm"]["z"] == 0
    assert sorted((z["/a/im2.dcm"]["z"], z["/b/im2.dcm"]["z"])) == [1, 2] and z["/a/im9.dcm"] == {"z": 0, "t": 1}
    axes = {(r.group_id[0], r.axis): (r.position, r.label, r["size"]) for r in datasets.series_axes(h).collect()}
    assert axes == {("s", "z"): (0, "Slice", 3), ("s", "t"): (2, "Time", 2), ("f", "frame"): (1, "Frame", 5)}
    assert sorted((r.axis, r["index"], r.value) for r in datasets.series_axis_values(h).collect()) == [("t", 0, 0.0), ("t", 1, 3.0)]


def fits(values_, **cards):
    head = {"SIMPLE": "T", "BITPIX": 16, "NAXIS": 2, "NAXIS1": 2, "NAXIS2": 2, **cards}
    text_ = "".join(f"{k:<8}= {v!s:>20}".ljust(80) for k, v in head.items()) + "END".ljust(80)
    body = struct.pack(">4h", *values_)
    return text_.ljust(2880).encode() + body.ljust(2880, b"\0")


def test_file_formats(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12, dtype="<u2").reshape(3, 4))
    np.save(tmp_path / "rgb.npy", np.arange(24, dtype="float32").reshape(2, 4, 3))
    (tmp_path / "b.pfm").write_bytes(b"Pf\n2 2\n-1.0\n" + struct.pack("<4f", 1, 2, 3, 4))
    (tmp_path / "c.ppm").write_bytes(b"P6\n# note\n1 2\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "d.pbm").write_bytes(b"P4 3 1\n" + bytes([0b10100000]))
    (tmp_path / "e.fits").write_bytes(fits([20, -100, 300, -400], BSCALE=2.5, BZERO=100))
    (tmp_path / "f.fits").write_bytes(fits([-7, 1, 2, -7], BLANK=-7))
    (tmp_path / "bad.npy").write_bytes(b"nonsense")
    (tmp_path / "x.tif").write_bytes(b"II*")
    t, planes, bad = raster_files.ingest(raster_files.read_files(spark, str(tmp_path)), tile=3)
    px = {}
    for r in raster_files.tiles_to_samples(t).collect():
        px.setdefault(r.image_id.rsplit("/", 1)[1], {})[r.channel, r.y, r.x] = r.value
    assert px["a.npy"][0, 2, 3] == 11 and px["rgb.npy"][2, 1, 3] == 23
    assert [px["b.pfm"][0, y, x] for y in (0, 1) for x in (0, 1)] == [3, 4, 1, 2]
    assert px["c.ppm"][1, 1, 0] == 5 and [px["d.pbm"][0, 0, x] for x in range(3)] == [0, 255, 0]
    assert [px["e.fits"][0, y, x] for y in (0, 1) for x in (0, 1)] == [850, -900, 150, -150]
    assert math.isnan(px["f.fits"][0, 1, 0]) and px["f.fits"][0, 1, 1] == 1
    h = {r.image_id.rsplit("/", 1)[1]: r for r in planes.collect()}
    assert (h["e.fits"].type_min, h["e.fits"].type_max) == (-81820, 82017.5) and h["a.npy"].numeric_type == "uint16"
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"bad.npy", "x.tif"}


def test_export_files(spark, tmp_path):
    rows = spark.createDataFrame([("i;1", 1.5, NAN), ("j", 2.0, 0.25)], "image_id string, area double, mean double")
    prov = spark.createDataFrame([("i;1", "mm"), ("j", "px")], "image_id string, unit string")
    t = tables.export_rows(rows, prov, tables.present_columns(rows, ["image_id", "area", "mean", "length"]), decimal=",")
    tables.write_export(t, str(tmp_path / "out"), delimiter=";")
    lines = {line for f in (tmp_path / "out").rglob("*.csv") for line in f.read_text().splitlines()}
    assert lines == {"image_id;area;mean;unit", '"i;1";1,5;NaN;mm', "j;2;0,25;px"}


def test_stream_keeps_latest_rows(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    ddl = "image_id string, area double"
    measure = lambda b: b.groupBy("image_id").agg(F.sum("area").alias("area"))
    for batch in ([("a", 1.0), ("b", 2.0)], [("a", 5.0), ("a", 6.0)]):
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(src)
        incremental.collect_results(spark.readStream.schema(ddl).parquet(src), measure, out, state).trigger(availableNow=True).start().awaitTermination()
    got = {r.image_id: r.area for r in incremental.latest_results(spark, out).collect()}
    assert got == {"a": 11.0, "b": 2.0}


def test_saddles_in_turn_and_by_rounds_agree_on_ties(spark):
    import numpy as np
    import pandas as pd

    rows, peaks, want = [], [], {}
    for image in range(60):
        dice = np.random.default_rng(image)
        n = 9
        height = {t: float(dice.integers(4, 7)) for t in range(n)}
        pairs = sorted({tuple(sorted(map(int, dice.choice(n, 2, replace=False)))) for _ in range(16)})
        own = [(a, b, float(dice.integers(2, 5))) for a, b in pairs]
        rows += [(image, *r) for r in own]
        peaks += [(image, t, h) for t, h in height.items()]
        frame = pd.DataFrame([(*r, height[r[0]], height[r[1]]) for r in own], columns=["a", "b", "saddle", "peak_a", "peak_b"])
        want |= {(image, t): k for t, k in objects._merge_in_turn(frame, 2.0).itertuples(index=False)}
    got = objects._merge_by_rounds(spark.createDataFrame(peaks, "image int, top long, height double"),
                                   spark.createDataFrame(rows, "image int, a long, b long, saddle double"), ["image"], 2.0).collect()
    found = {(r.image, r.top): r.basin for r in got}
    assert {k: found[k] for k in want} == want

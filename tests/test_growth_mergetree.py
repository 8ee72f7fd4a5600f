"""Minimax region growing and merge-tree counts against brute force, for several tile sizes."""

import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeweave.operators import growth, mergetree, objects, stats, thresholds
from planeweave.schema import PLANE
from tests.conftest import disc, raster

NEAR = {4: [(0, 1), (1, 0), (0, -1), (-1, 0)], 8: [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]}


def flood(grid, y, x, tolerance, connectivity):
    seed = grid[y][x]
    seen, queue = {(y, x)}, deque([(y, x)])
    while queue:
        a, b = queue.popleft()
        for dy, dx in NEAR[connectivity]:
            p = (a + dy, b + dx)
            if p not in seen and 0 <= p[0] < len(grid) and 0 <= p[1] < len(grid[0]) and abs(grid[p[0]][p[1]] - seed) <= tolerance:
                seen.add(p)
                queue.append(p)
    return seen


def noisy(h, w, seed, holes=0):
    dice = np.random.default_rng(seed)
    g = np.cumsum(np.cumsum(dice.normal(0, 1, (h, w)), 0), 1) / 10
    for y, x in zip(dice.integers(0, h, holes), dice.integers(0, w, holes)):
        g[y, x] = dice.choice([math.nan, math.inf, -math.inf])
    return np.round(g, 1)


def seeds_of(spark, points):
    return spark.createDataFrame([(i, "i", 0, y, x) for i, (y, x) in enumerate(points)], "seed_id long, image_id string, page int, y int, x int")


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [12, 64])
def test_regions_equal_a_flood(spark, tile, connectivity):
    g = noisy(23, 31, 4, holes=40)
    points = [(0, 0), (11, 15), (22, 30), (5, 5), (7, 20)]
    points = [p for p in points if math.isfinite(g[p])]
    s = raster(spark, g)
    head = stats.plane_headers(s)
    r = growth.reach(seeds_of(spark, points).withColumn("tolerances", F.array(F.lit(0.3), F.lit(1.0), F.lit(2.5))), s, head, connectivity, tile=tile)
    got = {(t.seed_id, t.step): (t.area, t.bx, t.by, t.width, t.height) for t in growth.totals(r).collect()}
    pixels = {}
    for m in growth.members(r, tile).collect():
        pixels.setdefault(m.seed_id, {})[m.y, m.x] = m.cost
    for i, (y, x) in enumerate(points):
        for k, t in enumerate((0.3, 1.0, 2.5)):
            want = flood(g, y, x, t, connectivity)
            ys, xs = [p[0] for p in want], [p[1] for p in want]
            assert got[i, k] == (len(want), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
            assert {p for p, c in pixels[i].items() if c <= t} == want


def test_a_sweep_through_many_tiles_equals_one_tile(spark, monkeypatch):
    """A corridor that crosses the border of two tiles once in every other line, and seeds whose sweeps leak."""
    monkeypatch.setattr(growth, "COMPACT", 2)
    g = np.full((7, 12), 50.0)
    g[::2] = 1 + np.arange(48).reshape(4, 12) % 7 * 0.1
    g[1, 11] = g[3, 0] = g[5, 11] = 1.2
    s = raster(spark, g)
    head = stats.plane_headers(s)
    seeds = seeds_of(spark, [(0, 0), (4, 6), (1, 3)])
    a, b = (sorted(map(tuple, growth.grow_regions_auto(seeds, s, head, connectivity=4, tile=t).collect())) for t in (7, 64))
    assert a == b
    one = growth.grow_regions(seeds, s, head, 0.7, 4, tile=7).where("seed_id = 0").first()
    assert one.area == len(flood(g, 0, 0, 0.7, 4)) == 51


def test_seeds_without_a_region(spark):
    g = np.ones((6, 6))
    g[2, 2] = math.nan
    s = raster(spark, g)
    got = growth.grow_regions(seeds_of(spark, [(2, 2), (9, 9), (0, 0)]), s, stats.plane_headers(s), 0.5)
    assert [(r.seed_id, r.area, r.leaked) for r in got.collect()] == [(2, 35, True)]
    assert growth.grow_regions(seeds_of(spark, [(2, 2)]), s, stats.plane_headers(s), 0.5).count() == 0


def components(on):
    left, n = set(zip(*map(list, np.nonzero(on)))), 0
    while left:
        n += 1
        queue = [left.pop()]
        while queue:
            a, b = queue.pop()
            for dy, dx in NEAR[4]:
                if (a + dy, b + dx) in left:
                    left.remove((a + dy, b + dx))
                    queue.append((a + dy, b + dx))
    return n


@pytest.mark.parametrize("dark", [True, False])
@pytest.mark.parametrize("tile", [8, 64])
def test_curve_equals_counting_every_mask(spark, tile, dark):
    g = noisy(37, 50, 8, holes=60)
    s = raster(spark, g)
    ok = np.isfinite(g)
    lo, hi = g[ok].min(), g[ok].max()
    head = spark.createDataFrame([("i", 0, float(lo), float(hi))], "image_id string, page int, lo double, hi double")
    curve, pick = objects.stability_curve(s, stats.plane_headers(s), head, samples=20, dark_background=dark, tile=tile)
    rows = curve.orderBy("bin_index").collect()
    assert [r.bin for r in rows] == thresholds.stability_bins(20)
    for r in rows:
        on = ok & ((g >= r.value) if dark else (g <= r.value))
        assert (r.object_count, round(r.area_fraction * g.size)) == (components(on), on.sum())
    assert pick.count() == 1


def test_a_constant_plane_and_one_without_values(spark):
    s = raster(spark, np.full((9, 9), 3.0)).unionByName(raster(spark, np.full((3, 3), math.nan), page=1))
    head = s.where(F.abs("value") < math.inf).groupBy(*PLANE).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    curve, _ = objects.stability_curve(s, stats.plane_headers(s), head, samples=8, tile=4)
    assert {(r.page, r.object_count, r.area_fraction) for r in curve.collect()} == {(0, 1, 1.0)}


def test_squares_hand_up_borders_only(spark):
    """Of a square's rows at the top, none is an inner pixel, however noisy the plane."""
    g = np.random.default_rng(1).integers(0, 9, (64, 64)).astype(float)
    lev = raster(spark, g).select(*PLANE, "y", "x", (F.col("value") + 1).cast("int").alias("level"))
    pdf = lev.toPandas()
    u, level = (pdf.y.to_numpy(np.int64) * mergetree.ROW + pdf.x.to_numpy(np.int64)), pdf.level.to_numpy(np.int64)
    rows = mergetree._rows(u, level, mergetree._steps(u, level, None), 64, mergetree.Counter(), mergetree.Counter())
    assert (rows.kind == mergetree.VERTEX).sum() <= 4 * 64 and (rows.kind == mergetree.EDGE).sum() <= 4 * 64


def test_leaks_end_a_sweep(spark):
    g = disc(32, 32, [(16, 16, 8)], inside=200.0, outside=20.0)
    dice = np.random.default_rng(2)
    g = np.array(g) + dice.normal(0, 2, (32, 32)).round(1)
    s = raster(spark, g)
    r = growth.grow_regions_auto(seeds_of(spark, [(16, 16)]), s, stats.plane_headers(s), tile=8).first()
    assert abs(r.area - math.pi * 64) < 20 and r.tolerance < 180

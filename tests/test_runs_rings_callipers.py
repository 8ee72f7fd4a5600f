"""Hole filling on runs, nearest outlines by rings, callipers and sliding medians, each against brute force."""

import math

import numpy as np
import pytest

from conftest import raster
from planeweave.operators import components, neighbourhood, objects, rois
from planeweave.schema import PIXEL

ROI = ("roi_id bigint, image_id string, page int, kind string, x double, y double, width double, height double, angle double, "
       "line_width int, points array<double>")


def _filled(pixels: set) -> set:
    """The pixels and what the border of their box does not reach through the background, in steps of four."""
    ys, xs = [y for y, _ in pixels], [x for _, x in pixels]
    box = {(y, x) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1)}
    seen = {(y, x) for y, x in box - pixels if y in (min(ys), max(ys)) or x in (min(xs), max(xs))}
    todo = list(seen)
    while todo:
        y, x = todo.pop()
        for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if q in box and q not in pixels and q not in seen:
                seen.add(q)
                todo.append(q)
    return box - seen


@pytest.mark.parametrize("share", [0.45, 0.6, 0.75])
def test_holes_by_runs(spark, share):
    grid = np.random.default_rng(int(share * 100)).random((40, 150)) < share  # wider than a block of columns
    labels = components.label_components(raster(spark, grid.astype(float)).where("value > 0").select(*PIXEL), 8).cache()
    own, got = {}, {}
    for r in labels.collect():
        own.setdefault(r.label, set()).add((r.y, r.x))
    rows = [(r.label, r.y, r.x) for r in objects.fill_holes(labels).collect()]
    assert len(rows) == len(set(rows))
    for label, y, x in rows:
        got.setdefault(label, set()).add((y, x))
    assert got == {label: _filled(p) for label, p in own.items()}


def test_holes_of_an_object_in_parts(spark):
    """A label with empty lines between its parts: gaps beside such a line are open."""
    rows = ["#####", "#...#", "#####", ".....", "##.##", "#####", "#...#", "#####"]
    px = spark.createDataFrame([("i", 0, 1, y, x) for y, line in enumerate(rows) for x, c in enumerate(line) if c == "#"],
                               "image_id string, page int, label long, y int, x int")
    want = _filled({(r.y, r.x) for r in px.collect()})
    assert {(r.y, r.x) for r in objects.fill_holes(px).collect()} == want


def _distance(px, py, pts, closed):
    ends = list(zip(pts, pts[1:] + pts[:1])) if closed else list(zip(pts, pts[1:])) or [(pts[0], pts[0])]
    best = math.inf
    for (ax, ay), (bx, by) in ends:
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = 0 if n == 0 else max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n))
        best = min(best, math.hypot(ax + t * (bx - ax) - px, ay + t * (by - ay) - py))
    return best


def test_nearest_outline_at_any_distance(spark):
    rng = np.random.default_rng(4)
    shapes, rows = {}, []
    for i in range(30):
        x, y = map(float, rng.uniform(0, 3000, 2).round(1))
        kind = ("polygon", "polyline", "point")[i % 3]
        pts = [(x, y), (x + 9, y + 2), (x + 4, y + 11)] if kind != "point" else [(x, y)]
        shapes[i] = (pts, kind == "polygon")
        rows.append((i, "i", 0, kind, None, None, None, None, 0.0, 1, [c for p in pts for c in p]))
    rows.append((99, "i", 0, "polygon", None, None, None, None, 0.0, 1, [0.0, float("nan"), 1.0, 1.0, 2.0, 0.0]))  # no finite outline
    rows.append((98, "i", 0, "polygon", None, None, None, None, 0.0, 1, None))
    pts = [(k, "i", 0, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(-40000, 40000, (25, 2)))]
    pts += [(100 + k, "i", 0, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(0, 3000, (25, 2)))]
    pts += [(200, "i", 1, 5.0, 5.0), (201, "i", 0, float("nan"), 1.0), (202, "i", 0, None, 1.0)]
    points = spark.createDataFrame(pts, "point_id long, image_id string, page int, px double, py double")
    got = {r.point_id: r for r in rois.nearest_roi(points, spark.createDataFrame(rows, ROI)).collect()}
    assert len(got) == len(pts) and all(got[k].roi_id is None for k in (200, 201, 202))
    for k, _, _, px, py in pts[:50]:
        d, i = min((_distance(px, py, p, c), i) for i, (p, c) in shapes.items())
        assert got[k].roi_id == i and math.isclose(got[k].distance, d, abs_tol=1e-6)


def test_nearest_outline_without_any(spark):
    points = spark.createDataFrame([(1, "i", 0, 1.0, 1.0)], "point_id long, image_id string, page int, px double, py double")
    assert [tuple(r) for r in rois.nearest_roi(points, spark.createDataFrame([], ROI)).collect()] == [(1, "i", 0, None, None)]


def test_callipers():
    rng = np.random.default_rng(9)
    clouds = [rng.normal(size=(n, 2)) for n in (2, 3, 4, 10, 300)] + [rng.integers(0, 6, (40, 2)).astype(float) for _ in range(20)]
    clouds += [np.array([[math.cos(k / n * math.tau), math.sin(k / n * math.tau)] for k in range(n)]) for n in (3, 4, 5, 6, 96, 97)]
    clouds += [np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float), np.array([[0, 0], [1, 1], [2, 2]], float), np.array([[1, 1], [1, 1]], float)]
    for cloud in clouds:
        for pw, ph in ((1.0, 1.0), (2.0, 0.5)):
            _, far, angle, width, fx, fy = rois._feret(cloud.ravel(), pw, ph)
            p = cloud * (pw, ph)
            d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
            assert math.isclose(far, d.max(), abs_tol=1e-9) and 0 <= angle <= 180
            hull = rois._hull(cloud) * (pw, ph)
            least = 0.0
            if len(hull) > 2:
                e = np.roll(hull, -1, axis=0) - hull
                away = np.abs((hull[None, :, 0] - hull[:, None, 0]) * e[:, None, 1] - (hull[None, :, 1] - hull[:, None, 1]) * e[:, None, 0])
                least = (away.max(axis=1) / np.hypot(e[:, 0], e[:, 1])).min()
            assert math.isclose(width, least, abs_tol=1e-9)


@pytest.mark.parametrize("rad", [1, 3, 9])
def test_window_medians(rad):
    rng = np.random.default_rng(rad)
    grid = rng.integers(0, 64, (30, 37)).astype(np.uint8)
    grid[rng.random(grid.shape) < 0.4] = neighbourhood.NO_BIN
    got = neighbourhood._window_medians(grid, rad)
    for y in range(got.shape[0]):
        for x in range(got.shape[1]):
            w = np.sort(grid[y:y + 2 * rad + 1, x:x + 2 * rad + 1].ravel())
            w = w[w < neighbourhood.NO_BIN]
            assert not len(w) or got[y, x] == w[(len(w) + 1) // 2 - 1]


def test_local_median_of_a_radius_beyond_the_tile(spark):
    g = np.random.default_rng(3).normal(size=(30, 41))
    s = raster(spark, g)
    small, large = ({(r.y, r.x) for r in neighbourhood.local_median(s, 11, 0.1, tile=t).collect()} for t in (4, 64))
    assert small == large and small

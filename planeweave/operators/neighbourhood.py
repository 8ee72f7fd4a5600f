"""Windowed filters over lines of dense planes.

Box and separable filters run as two passes: windows over one row, then over one column.
A window partition is one line of one plane, so it is bounded by the plane's width or
height; no task ever holds a whole plane. ``lag``/``lead`` count rows, so inputs must be
dense (``sources.views.densify``): NaN marks a missing sample, NULL the outside.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from planeweave.functions.numeric import INF, f32, finite, nan, only_finite
from planeweave.operators import thresholds as T
from planeweave.operators.stats import floor_bin
from planeweave.schema import PIXEL, PLANE

AXES = (("y", "x"), ("x", "y"))  # (line key, position on the line): row pass, column pass


CHANNEL = [*PLANE, "channel"]


def line(axis: tuple[str, str], keys: list[str] = PLANE) -> WindowSpec:
    """One line of one plane, or of each channel of it with ``keys=CHANNEL``."""
    return Window.partitionBy(*keys, axis[0]).orderBy(axis[1])


def box(axis: tuple[str, str], radius: int, keys: list[str] = PLANE) -> WindowSpec:
    return line(axis, keys).rangeBetween(-radius, radius)


def at(c: str, k: int, w: WindowSpec) -> Column:
    """Value ``k`` positions along the line; NULL outside."""
    if k == 0:
        return F.col(c)
    return F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)


def at_clamped(c: str, k: int, w: WindowSpec) -> Column:
    """As :func:`at`, repeating the edge sample outside."""
    if k == 0:
        return F.col(c)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # evaluated once per line
    edge = (F.first(c) if k < 0 else F.last(c)).over(whole)
    return F.coalesce(at(c, k, w), edge)


def _radius(radius: float) -> int:
    return max(1, math.floor(radius + 0.5))


def gaussian_kernel(sigma: float) -> list[float]:
    r = max(1, math.ceil(3 * sigma))
    w = [math.exp(-(k * k) / (2.0 * sigma * sigma)) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def gaussian_blur(plane: DataFrame, sigma: float) -> DataFrame:
    """Separable blur; indices clamp at the edge, non-finite samples are skipped and the
    weights renormalised. The intermediate is single precision. ``sigma <= 0`` copies."""
    if not sigma > 0:
        return plane
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    for axis in AXES:
        w = line(axis, CHANNEL)
        taps = [at_clamped("value", k, w).alias(f"_t{k + r}") for k in range(-r, r + 1)]
        plane = plane.select(*PIXEL, "channel", *taps)
        num = den = F.lit(0.0)
        for i, weight in enumerate(kernel):
            t = F.col(f"_t{i}")
            num = num + F.when(finite(t), t * weight).otherwise(0.0)
            den = den + F.when(finite(t), F.lit(weight)).otherwise(0.0)
        plane = plane.select(*PIXEL, "channel", F.when(den > 0, f32(num / F.when(den > 0, den))).otherwise(nan()).alias("value"))
    return plane


def gaussian_blur_sparse(samples: DataFrame, planes: DataFrame, sigma: float) -> DataFrame:
    """The same blur for planes with few samples: every finite sample is sent to the
    positions that read it (edge samples once per clamped offset) and summed per target."""
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    weights = F.array(*[F.lit(k) for k in kernel])
    out = samples.where(finite("value")).select(*PIXEL, "channel", "value").join(
        planes.select(*PLANE, "width", "height"), PLANE)
    for (_, pos), size in zip(AXES, ("width", "height")):
        p = F.col(pos)
        sent = out.withColumn("_to", F.explode(F.sequence(F.greatest(p - r, F.lit(0)), F.least(p + r, F.col(size) - 1))))
        k = p - F.col("_to")
        # An edge sample also serves every offset that points beyond its edge.
        w_in = F.element_at(weights, k + r + 1)
        beyond_low = F.when(p == 0, F.aggregate(F.slice(weights, 1, F.greatest(k + r, F.lit(0))), F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)
        beyond_high = F.when(p == F.col(size) - 1, F.aggregate(
            F.slice(weights, k + r + 2, F.greatest(r - k, F.lit(0))), F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)
        sent = sent.withColumn("_w", w_in + beyond_low + beyond_high).withColumn(pos, F.col("_to"))
        out = sent.groupBy(*PIXEL, "channel", "width", "height").agg(
            f32(F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))
    return out.drop("width", "height")


def extremum_filter(plane: DataFrame, radius: int, minimum: bool) -> DataFrame:
    """Minimum or maximum of the finite samples in a square window, NaN without any."""
    pick = F.min if minimum else F.max
    for axis in AXES:
        plane = plane.select(*PIXEL, "channel",
                             pick(only_finite("value")).over(box(axis, radius, CHANNEL)).alias("value"))
    return plane.withColumn("value", F.coalesce("value", nan()))


def subtract_background(plane: DataFrame, radius: float, light_background: bool = False) -> DataFrame:
    """Value minus its opening; a light background works on negated values."""
    r, sign = _radius(radius), (-1.0 if light_background else 1.0)
    p = plane.select(*PIXEL, "channel", (F.col("value") * sign).alias("value")).withColumn("_v", F.col("value"))
    for minimum in (True, False):
        pick = F.min if minimum else F.max
        for axis in AXES:
            p = p.select(*PIXEL, "channel", "_v", pick(only_finite("value")).over(box(axis, r, CHANNEL)).alias("value"))
    out = F.when(finite("_v"), (F.col("_v") - F.col("value")) * sign).otherwise(nan())
    return p.select(*PIXEL, "channel", f32(out).alias("value"))


def gradient_magnitude(plane: DataFrame) -> DataFrame:
    """Central differences with clamped edges; 0 where any neighbour is not finite."""
    row, column = line(AXES[0], CHANNEL), line(AXES[1], CHANNEL)
    n = plane.select(*PIXEL, "channel", "value",
                     F.coalesce(at("value", -1, row), "value").alias("l"), F.coalesce(at("value", 1, row), "value").alias("r"))
    n = n.select(*PIXEL, "channel", "l", "r",
                 F.coalesce(at("value", -1, column), "value").alias("u"), F.coalesce(at("value", 1, column), "value").alias("d"))
    ok = finite("l") & finite("r") & finite("u") & finite("d")
    mag = F.hypot((F.col("r") - F.col("l")) / 2, (F.col("d") - F.col("u")) / 2)
    return n.select(*PIXEL, "channel", F.when(ok, f32(mag)).otherwise(0.0).alias("value"))


def _ranges(plane: DataFrame) -> DataFrame:
    v = only_finite("value")
    return plane.groupBy(*PLANE).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).where(F.col("lo").isNotNull())


def _reflected(plane: DataFrame, bright_objects: bool) -> DataFrame:
    """Finite samples with their plane's range, mirrored about it for bright objects."""
    p = plane.join(_ranges(plane), PLANE)
    if bright_objects:
        p = p.withColumn("value", F.when(finite("value"), f32(F.col("lo") + F.col("hi") - F.col("value"))).otherwise(nan()))
    return p


LOCAL_METHODS = ("sauvola", "niblack", "phansalkar", "mean", "median")


def local_threshold(plane: DataFrame, method: str, radius: float, k: float = 0.2, r: float | None = None,
                    offset: float = 0.0, dark_background: bool = True) -> DataFrame:
    """Mask pixels at or below a threshold surface made of box means and deviations."""
    if method == "median":
        return local_median(plane, radius, offset, dark_background)
    rad = _radius(radius)
    p = _reflected(plane, dark_background).withColumn("_f", only_finite("value"))
    row, column = box(AXES[0], rad), box(AXES[1], rad)
    p = p.select(*PIXEL, "value", "lo", "hi", F.sum("_f").over(row).alias("s"),
                 F.sum(F.col("_f") * F.col("_f")).over(row).alias("q"), F.count("_f").over(row).alias("n"))
    p = p.select(*PIXEL, "value", "lo", "hi", F.sum("s").over(column).alias("s"),
                 F.sum("q").over(column).alias("q"), F.sum("n").over(column).alias("n"))
    n = F.nullif(F.col("n"), F.lit(0).cast("long"))
    m = F.col("s") / n
    sd = F.sqrt(F.greatest(F.col("q") / n - m * m, F.lit(0.0)))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    rr = F.lit(float(r)) if r is not None else span / 2
    cut = {
        "sauvola": m * (1 + k * (sd / rr - 1)),
        "niblack": m - k * sd,
        "phansalkar": m * (1 + 2 * F.exp(-10 * ((m - F.col("lo")) / span)) + k * (sd / rr - 1)),
    }.get(method, m - offset)
    return p.where(finite("value") & (F.col("value") <= cut)).select(*PIXEL)


def local_median(plane: DataFrame, radius: float, offset: float = 0.0, dark_background: bool = True,
                 tile: int = 64) -> DataFrame:
    """Mask pixels at or below the local median of 64 bins.

    The median bin is the lower median of the window's bins. Samples are packed to tiles of a byte per
    pixel; a tile gets those around it, never smaller than the radius, so that eight are enough.
    Inside, a histogram per column slides down a line at a time and window counts are differences of
    running sums along the line: a sample costs the same whatever the radius.
    """
    rad = _radius(radius)
    tile = max(tile, rad)
    p = _reflected(plane, dark_background).where("hi > lo")
    # Reflection maps the range onto itself, up to single precision; bins use the new range.
    p = p.drop("lo", "hi").join(_ranges(p.drop("lo", "hi")), PLANE).where("hi > lo")
    p = p.where(finite("value")).withColumn("bin", floor_bin(F.col("value"), F.col("lo"), F.col("hi"), MEDIAN_BINS))
    p = p.select(*PIXEL, "value", "lo", "hi", "bin", F.expr(f"cast(y div {tile} as int)").alias("ty"), F.expr(f"cast(x div {tile} as int)").alias("tx"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[2]), int(key[3])
        y, x = pdf.y.to_numpy() - ty * tile, pdf.x.to_numpy() - tx * tile
        bins = np.full((tile, tile), NO_BIN, np.uint8)
        bins[y, x] = pdf.bin.to_numpy()
        order = np.argsort(y * tile + x, kind="stable")
        return pd.DataFrame([(key[0], key[1], ty, tx, float(pdf.lo.iloc[0]), float(pdf.hi.iloc[0]), bins.tobytes(), pdf.value.to_numpy(float)[order].tobytes())],
                            columns=["image_id", "page", "ty", "tx", "lo", "hi", "bins", "values"])

    packed = p.groupBy(*PLANE, "ty", "tx").applyInPandas(pack, "image_id string, page int, ty int, tx int, lo double, hi double, bins binary, values binary")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    sent = packed.withColumn("s", F.explode(steps))
    own = (F.col("s.dy") == 0) & (F.col("s.dx") == 0)
    sent = sent.select(*PLANE, (F.col("ty") + F.col("s.dy")).alias("ty"), (F.col("tx") + F.col("s.dx")).alias("tx"), F.col("s.dy").alias("dy"), F.col("s.dx").alias("dx"),
                       "lo", "hi", "bins", F.when(own, F.col("values")).alias("values"))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(key[2]), int(key[3])
        at_home = pdf[pdf["values"].notna()]
        if at_home.empty:  # a neighbour beyond the plane's samples
            return pd.DataFrame({"image_id": pd.Series([], dtype=str), "page": pd.Series([], dtype="int32"), "y": pd.Series([], dtype="int32"), "x": pd.Series([], dtype="int32")})
        grid = np.full((3 * tile, 3 * tile), NO_BIN, np.uint8)
        for dy, dx, bins in zip(pdf.dy, pdf.dx, pdf.bins):
            grid[(1 - dy) * tile:(2 - dy) * tile, (1 - dx) * tile:(2 - dx) * tile] = np.frombuffer(bins, np.uint8).reshape(tile, tile)
        median_bin = _window_medians(grid[tile - rad:2 * tile + rad, tile - rad:2 * tile + rad], rad)
        inner = grid[tile:2 * tile, tile:2 * tile]
        y, x = np.nonzero(inner != NO_BIN)
        lo, hi = float(at_home.lo.iloc[0]), float(at_home.hi.iloc[0])
        median = lo + (median_bin[y, x] + 0.5) / (MEDIAN_BINS / (hi - lo))
        keep = np.frombuffer(at_home["values"].iloc[0], float) <= median - offset
        return pd.DataFrame({"image_id": key[0], "page": key[1], "y": (y + ty * tile)[keep].astype(np.int32), "x": (x + tx * tile)[keep].astype(np.int32)})

    return sent.groupBy(*PLANE, "ty", "tx").applyInPandas(kernel, "image_id string, page int, y int, x int")


#: Bins of the local median, and the mark of a pixel without a sample.
MEDIAN_BINS = 64
NO_BIN = 255


def _window_medians(grid: np.ndarray, rad: int) -> np.ndarray:
    """Lower median bin of the square window around each pixel at least ``rad`` from the grid's sides; any value where it is empty."""
    side = 2 * rad + 1
    rows, width = grid.shape[0] - 2 * rad, grid.shape[1]
    column = np.arange(width)
    counts = np.zeros((MEDIAN_BINS, width), np.int32)

    def add(line: np.ndarray, sign: int) -> None:
        on = line != NO_BIN
        counts[line[on], column[on]] += sign  # a column occurs once in a line

    for line in grid[:side - 1]:
        add(line, 1)
    out = np.zeros((rows, width - 2 * rad), np.uint8)
    for r in range(rows):
        add(grid[r + side - 1], 1)
        run = np.zeros((MEDIAN_BINS, width + 1), np.int64)
        np.cumsum(counts, axis=1, out=run[:, 1:])
        upto = np.cumsum(run[:, side:] - run[:, :-side], axis=0)
        out[r] = np.argmax(upto >= (upto[-1] + 1) // 2, axis=0)
        add(grid[r], -1)
    return out


def local_auto_threshold(plane: DataFrame, planes: DataFrame, method: str, radius: float,
                         dark_background: bool = True, min_contrast: float = 0.25) -> DataFrame:
    """Any global method per neighbourhood, interpolated between the nodes of a grid.

    Nodes lie every ``radius`` pixels and see the window of that radius. A sample belongs
    to at most nine nodes and is counted per (node, bin) before the shuffle. Each grid cell
    gathers its four corner nodes into one row, so pixels meet the surface in one equi-join.
    """
    t = max(4, math.floor(radius + 0.5))
    span = F.col("hi") - F.col("lo")
    p = plane.where(finite("value")).join(_ranges(plane).where("hi > lo"), PLANE)
    hdr = planes.select(*PLANE, *[F.greatest(F.ceil(F.col(s) / t) + 1, F.lit(2).cast("long")).cast("int").alias(n)
                                  for s, n in (("height", "ny"), ("width", "nx"))])

    def nodes(c: str, n: str) -> Column:
        pos = F.col(c)
        return F.sequence(F.greatest(F.ceil((pos - t) / F.lit(float(t))).cast("int"), F.lit(0)),
                          F.least(F.floor((pos + t) / F.lit(float(t))).cast("int"), F.col(n) - 1))

    key = [*PLANE, "ty", "tx"]
    seen = (p.withColumn("bin", floor_bin(F.col("value"), F.col("lo"), F.col("hi"))).join(hdr, PLANE)
            .withColumn("ty", F.explode(nodes("y", "ny"))).withColumn("tx", F.explode(nodes("x", "nx")))
            .groupBy(*key, "lo", "hi", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("v0"), F.max("value").alias("v1")))
    contrast = seen.groupBy(*key, "lo", "hi").agg((F.max("v1") - F.min("v0")).alias("c")).where(
        F.col("c") >= min_contrast * span).select(*key)
    node = T.auto_threshold(seen.join(contrast, key, "left_semi"), method, key).where("threshold_bin >= 0").select(*key, "threshold")
    corner = node.select(*PLANE, "threshold", F.explode(F.expr(
        "array(struct(ty as cy, tx as cx, 0 as k), struct(ty as cy, tx - 1 as cx, 1 as k), "
        "struct(ty - 1 as cy, tx as cx, 2 as k), struct(ty - 1 as cy, tx - 1 as cx, 3 as k))")).alias("e"))
    cells = corner.select(*PLANE, "e.cy", "e.cx", "e.k", "threshold").groupBy(*PLANE, "cy", "cx").agg(
        *[F.max(F.when(F.col("k") == i, F.col("threshold"))).alias(f"g{i}") for i in range(4)])
    q = p.withColumn("cy", F.expr(f"y div {t}").cast("int")).withColumn("cx", F.expr(f"x div {t}").cast("int"))
    q = q.join(cells, [*PLANE, "cy", "cx"])
    fy, fx = (F.col("y") / F.lit(float(t)) - F.col("cy")), (F.col("x") / F.lit(float(t)) - F.col("cx"))
    w = [(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]
    num = den = F.lit(0.0)
    for i in range(4):
        use = F.col(f"g{i}").isNotNull() & (w[i] > 0)
        num = num + F.when(use, F.col(f"g{i}") * w[i]).otherwise(0.0)
        den = den + F.when(use, w[i]).otherwise(0.0)
    near = F.when(fy >= 0.5, F.when(fx >= 0.5, F.col("g3")).otherwise(F.col("g2"))).otherwise(
        F.when(fx >= 0.5, F.col("g1")).otherwise(F.col("g0")))
    cut = num / F.when(den > 0, den)
    on = F.col("value") >= cut if dark_background else F.col("value") <= cut
    return q.where(near.isNotNull() & on).select(*PIXEL)


FAR = 1e20


def distance_transform(mask: DataFrame, planes: DataFrame) -> DataFrame:
    """Exact squared distance of every pixel to the nearest background pixel of its plane.

    Pass 1 finds the nearest background in each column with ``last`` windows from either end.
    Pass 2 takes the lower envelope per row; a row is one array of at most ``width`` values.
    """
    grid = planes.select(*PLANE, "width", F.explode(F.expr("sequence(0, height - 1)")).alias("y")).withColumn(
        "x", F.explode(F.expr("sequence(0, width - 1)")))
    on = mask.select(*PIXEL).withColumn("_on", F.lit(1))
    d = grid.join(on, PIXEL, "left").withColumn("_bg", F.when(F.col("_on").isNull(), F.col("y")))
    up = F.last("_bg", ignorenulls=True).over(line(AXES[1]).rowsBetween(Window.unboundedPreceding, 0))
    upward = Window.partitionBy(*PLANE, "x").orderBy(F.desc("y"))  # the same frame from below: no frame grows anew for each row
    down = F.last("_bg", ignorenulls=True).over(upward.rowsBetween(Window.unboundedPreceding, 0))
    near = F.least(F.col("y") - up, down - F.col("y")).cast("double")
    d = d.select(*PIXEL, F.coalesce(near * near, F.lit(FAR)).alias("g"))
    rows = d.groupBy(*PLANE, "y").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("x", "g"))), lambda e: e["g"]).alias("g"))

    @F.pandas_udf("array<double>")
    def envelope(lines: pd.Series) -> pd.Series:
        return lines.map(_row_distances)

    return rows.select(*PLANE, "y", F.posexplode(envelope("g")).alias("x", "d2"))


def _row_distances(g) -> np.ndarray:
    """min over x' of g[x'] + (x - x')², by the lower envelope of the parabolas: linear in the row.

    The parabola of x' passes below that of p < x' from ``cross(p, x')`` on; a parabola that is
    overtaken before it overtakes its predecessor is never lowest.
    """
    g = np.asarray(g, dtype=float)
    cross = lambda p, q: (g[q] + q * q - g[p] - p * p) / (2.0 * (q - p))
    low: list[int] = []
    since: list[float] = []
    for x in range(g.size):
        at = -np.inf
        while low and (at := cross(low[-1], x)) <= since[-1]:
            low.pop()
            since.pop()
        since.append(at if low else -np.inf)
        low.append(x)
    x = np.arange(g.size)
    best = np.array(low)[np.searchsorted(np.array(since), x, side="right") - 1]
    return g[best] + (x - best) ** 2.0


def local_noise(seeds: DataFrame, plane: DataFrame, radius: int = 4) -> DataFrame:
    """Median absolute deviation × 1.4826 around each seed, upper medians, 0 below 3 values.

    Each seed asks for its window pixels by equi-join; the gathered list has at most
    ``(2 radius + 1)²`` entries.
    """
    offs = F.sequence(F.lit(-radius), F.lit(radius))
    ask = (seeds.select("seed_id", *PLANE, F.col("y").alias("sy"), F.col("x").alias("sx"))
           .withColumn("y", F.explode(F.transform(offs, lambda o: F.col("sy") + o)))
           .withColumn("x", F.explode(F.transform(offs, lambda o: F.col("sx") + o))))
    got = ask.join(plane.where(finite("value")).select(*PIXEL, "value"), PIXEL).groupBy("seed_id", *PLANE).agg(
        F.sort_array(F.collect_list("value")).alias("v"))
    got = seeds.select("seed_id", *PLANE).join(got, ["seed_id", *PLANE], "left")
    n = F.size("v")
    mid = F.get("v", F.floor(n / 2).cast("int"))
    g = got.withColumn("m", mid)
    dev = F.sort_array(F.transform("v", lambda e: F.abs(e - F.col("m"))))
    mad = F.get(dev, F.floor(n / 2).cast("int"))
    return g.select("seed_id", *PLANE, F.when(n >= 3, mad * 1.4826).otherwise(0.0).alias("noise"))

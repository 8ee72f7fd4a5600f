"""Automatic thresholds on 256-bin histograms.

A histogram is at most 256 rows per plane, so the cumulative methods are running window
sums over ``bin`` followed by ``max_by``; iterative methods see one ``array<bigint>`` per
plane in an Arrow-batched UDF. Input: the dense rows of :func:`dense`. Output: one row per
key with the chosen ``threshold_bin`` (-1 when the method finds none).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions.numeric import clamp
from planeweave.schema import PLANE

BINS = 256


def histogram_arrays(hist: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """``(keys, lo, hi, counts array<bigint>[256])`` from sparse ``(bin, n)`` rows."""
    m = F.map_from_entries(F.collect_list(F.struct("bin", "n")))  # at most 256 entries
    return hist.groupBy(*keys, "lo", "hi").agg(m.alias("_m")).select(
        *keys, "lo", "hi",
        F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)),
                    lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("counts"))


def dense(hist: DataFrame, keys: list[str] = PLANE, all_bins: bool = True) -> DataFrame:
    """Bins with running sums: c = counts, s = bin * n, q = n * n, g = n ln n.

    Counts stay integers, so running sums are exact and independent of order. Methods whose
    criterion cannot prefer an empty bin skip them (``all_bins=False``).
    """
    d = hist.select(*keys, "lo", "hi", "bin", "n")
    if all_bins:
        d = histogram_arrays(hist, keys).select(*keys, "lo", "hi", F.posexplode("counts").alias("bin", "n"))
    run = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    n, b = F.col("n"), F.col("bin")
    nln = F.when(n > 0, n * F.ln(n)).otherwise(F.lit(0.0))
    return d.select(
        *keys, "lo", "hi", "bin", "n",
        F.sum("n").over(run).alias("c"), F.sum(b * n).over(run).alias("s"),
        F.sum(n * n).over(run).alias("q"), F.sum(nln).over(run).alias("g"),
        F.sum("n").over(whole).alias("cn"), F.sum(b * n).over(whole).alias("sn"),
        F.sum(n * n).over(whole).alias("qn"), F.sum(nln).over(whole).alias("gn"))


def _best(d: DataFrame, keys: list[str], criterion: Column, valid: Column, largest: bool = True) -> DataFrame:
    """Bin with the extreme criterion, first bin on ties; -1 when no bin is valid."""
    score = criterion if largest else -criterion
    pick = F.max_by("bin", F.when(valid, F.struct(score.alias("v"), (-F.col("bin")).alias("b"))))
    return d.groupBy(*keys, "lo", "hi").agg(F.coalesce(pick, F.lit(-1)).alias("threshold_bin"))


def otsu(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Largest between-class variance."""
    fg = F.col("cn") - F.col("c")
    ok = (F.col("c") > 0) & (fg > 0)
    delta = F.try_divide(F.col("s"), F.col("c")) - F.try_divide(F.col("sn") - F.col("s"), fg)
    return _best(d, keys, F.col("c").cast("double") * fg.cast("double") * delta * delta, ok)


def yen(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Largest correlation criterion: 2 ln(P(1-P)) - ln(sum p² below * sum p² above)."""
    n2 = F.col("cn").cast("double") * F.col("cn")
    a = (F.col("q") / n2) * ((F.col("qn") - F.col("q")) / n2)
    p = F.col("c") / F.col("cn")
    b = p * (1 - p)
    # Empty bins repeat their predecessor's split, except the leading ones (criterion 0).
    crit = F.when(a > 0, -F.ln(F.when(a > 0, a))).otherwise(F.lit(0.0)) + \
        F.when(b > 0, 2 * F.ln(F.when(b > 0, b))).otherwise(F.lit(0.0))
    return _best(d, keys, crit, (F.col("cn") > 0) & ((F.col("n") > 0) | (F.col("bin") == 0)))


def max_entropy(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Largest sum of class entropies, each as ln(C) - (sum n ln n) / C."""
    c, fg = F.col("c"), F.col("cn") - F.col("c")
    ok = (c > 0) & (fg > 0)
    low = F.ln(F.when(c > 0, c)) - F.try_divide(F.col("g"), c)
    high = F.ln(F.when(fg > 0, fg)) - F.try_divide(F.col("gn") - F.col("g"), fg)
    return _best(d, keys, low + high, ok & (F.col("n") > 0))


def triangle(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Bin farthest from the chord between the peak and the end of the longer tail."""
    w = Window.partitionBy(*keys)  # 256 rows
    used = F.when(F.col("n") > 0, F.col("bin"))
    d = d.select(*keys, "lo", "hi", "bin", "n",
                 F.min(used).over(w).alias("first"), F.max(used).over(w).alias("last"),
                 F.max_by("bin", F.struct("n", -F.col("bin"))).over(w).alias("peak"),
                 F.max_by("bin", F.struct("n", "bin")).over(w).alias("peak_r"), F.max("n").over(w).alias("top"))
    flip = (F.col("peak") - F.col("first")) < (F.col("last") - F.col("peak"))
    # On the flipped side the histogram is read from bin 255 down: the peak becomes the
    # last maximum and the tail ends at the first used bin.
    d = d.select(*keys, "lo", "hi", "n", "top", "first", "last", flip.alias("flip"),
                 F.when(flip, 255 - F.col("bin")).otherwise(F.col("bin")).alias("b"),
                 F.when(flip, 255 - F.col("peak_r")).otherwise(F.col("peak")).alias("p"),
                 F.when(flip, 255 - F.col("first")).otherwise(F.col("last")).alias("e"))
    end_n = F.max(F.when(F.col("b") == F.col("e"), F.col("n"))).over(w)
    dx, dy = (F.col("e") - F.col("p")), F.col("end_n") - F.col("top")
    norm = F.sqrt((dx * dx).cast("double") + (dy * dy).cast("double"))
    d = d.withColumn("end_n", end_n)
    dist = F.abs(dy * (F.col("b") - F.col("p")) - dx * (F.col("n") - F.col("top"))) / F.nullif(norm, F.lit(0.0))
    inside = (F.col("b") >= F.col("p")) & (F.col("b") <= F.col("e"))
    g = d.groupBy(*keys, "lo", "hi").agg(
        F.first("first").alias("first"), F.first("last").alias("last"), F.first("flip").alias("flip"),
        F.first("p").alias("p"), F.first("e").alias("e"),
        F.max_by("b", F.when(inside, F.struct(dist, -F.col("b")))).alias("b"))
    side = F.when(F.col("e") <= F.col("p"), F.col("p")).otherwise(F.col("b"))
    bin_ = F.when(F.col("first") >= F.col("last"), F.lit(-1)).when(F.col("flip"), 255 - side).otherwise(side)
    return g.select(*keys, "lo", "hi", F.coalesce(bin_, F.lit(-1)).alias("threshold_bin"))


def mean(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Floor of the mean bin."""
    return d.groupBy(*keys, "lo", "hi").agg(
        F.coalesce(F.floor(F.try_divide(F.sum(F.col("bin") * F.col("n")), F.sum("n"))), F.lit(-1)).cast("int").alias("threshold_bin"))


def moments(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Two-level image with the same first three moments; first bin above its low fraction."""
    b, n = F.col("bin").cast("long"), F.col("n")
    g = d.groupBy(*keys, "lo", "hi").agg(
        F.sum(n).alias("N"), F.sum(b * n).alias("s1"), F.sum(b * b * n).alias("s2"), F.sum(b * b * b * n).alias("s3"),
        F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("_c"))  # 256 entries
    m1, m2, m3 = (F.try_divide(F.col(s), F.col("N")) for s in ("s1", "s2", "s3"))
    g = g.select("*", m1.alias("m1"), m2.alias("m2"), m3.alias("m3"))
    m1, m2, m3 = F.col("m1"), F.col("m2"), F.col("m3")
    cd = F.nullif(m2 - m1 * m1, F.lit(0.0))
    c0, c1 = (m1 * m3 - m2 * m2) / cd, (m2 * m1 - m3) / cd
    disc = c1 * c1 - 4 * c0
    root = F.when(disc > 0, F.sqrt(F.when(disc > 0, disc)))
    p0 = ((-c1 + root) / 2 - m1) / root
    g = g.withColumn("p0", p0)
    hit = F.filter("_c", lambda e: e["c"] / F.col("N") > F.col("p0"))
    return g.select(*keys, "lo", "hi", F.coalesce(F.get(hit, 0)["bin"], F.lit(-1)).alias("threshold_bin"))


def percentile(d: DataFrame, keys: list[str] = PLANE) -> DataFrame:
    """Bin whose cumulative share is nearest to one half."""
    return _best(d, keys, F.abs(F.col("c") / F.nullif(F.col("cn"), F.lit(0)) - 0.5), F.col("cn") > 0, largest=False)


# --- iterative methods: 256 counts in, one bin out ------------------------------------


def _isodata(c: np.ndarray) -> int:
    """Fixed point of the rounded midpoint of the two class means."""
    used = np.flatnonzero(c)
    floor_bin = int(used[0]) if used.size else 0
    cum, mass = np.cumsum(c), np.cumsum(np.arange(BINS) * c)
    t = BINS // 2
    for _ in range(1000):
        k = min(max(t, 0), BINS - 1)
        below, above = cum[k], cum[-1] - cum[k]
        if below == 0 or above == 0:
            break
        new = int(np.floor((mass[k] / below + (mass[-1] - mass[k]) / above) / 2 + 0.5))
        if new == t:
            break
        t = new
    return max(t, floor_bin)


def _li(c: np.ndarray) -> int:
    """Minimum cross-entropy: logarithmic mean of the class means until it moves <= 0.5."""
    if c.sum() == 0:
        return -1
    cum, mass = np.cumsum(c), np.cumsum(np.arange(BINS) * c)
    t = mass[-1] / cum[-1]
    for _ in range(1000):
        k = int(np.clip(np.floor(t + 0.5), 0, BINS - 1))
        low = mass[k] / cum[k] if cum[k] else 0.0
        rest = cum[-1] - cum[k]
        high = (mass[-1] - mass[k]) / rest if rest else 0.0
        low, high = max(low, 1e-9), max(high, 1e-9)
        with np.errstate(all="ignore"):
            new = (high - low) / (np.log(high) - np.log(low)) if high != low else np.nan
        moved, t = abs(new - t), new
        if not np.isfinite(t):
            return 0
        if moved <= 0.5:
            break
    return int(np.floor(t))


def _huang(c: np.ndarray) -> int:
    """Smallest fuzzy entropy, with the published cost 0 for full membership.

    The cost at distance zero is 0, the limit of -x ln x; evaluating 0 ln 0 as NaN would
    make every entropy NaN and always return the first used bin.
    """
    used = np.flatnonzero(c)
    if used.size == 0:
        return -1
    first, last = int(used[0]), int(used[-1])
    if first == last:
        return first
    member = 1.0 / (1.0 + np.arange(BINS) / (last - first))
    cost = np.zeros(BINS)
    m = member[1:]
    cost[1:] = -m * np.log(m) - (1 - m) * np.log(1 - m)
    bins = np.arange(BINS)
    cum, mass = np.cumsum(c), np.cumsum(bins * c)
    split = np.arange(first, last + 1)
    low = np.floor(mass[split] / cum[split] + 0.5)
    rest = cum[last] - cum[split]
    high = np.floor(np.divide(mass[last] - mass[split], rest, out=np.zeros(split.size), where=rest > 0) + 0.5)
    centre = np.where(bins[None, :] <= split[:, None], low[:, None], high[:, None])
    entropy = (cost[np.abs(bins[None, :] - centre).astype(int)] * c[None, :]).sum(axis=1)
    return int(split[np.argmin(np.round(entropy, 9))])


def _shanbhag(c: np.ndarray) -> int:
    """Information difference of the two classes with running survival products.

    The background pairs p[i] with the product that has consumed bins t down to t-i+1.
    """
    total = c.sum()
    if total == 0:
        return -1
    p = c / total
    cum = np.cumsum(p)

    def information(weights: np.ndarray, removed: np.ndarray, mass: float) -> float:
        left = np.cumprod((mass - removed) / mass)
        stop = np.flatnonzero(~(left > 0))
        k = int(stop[0]) if stop.size else left.size
        return float(-(weights[:k] * np.log(left[:k])).sum() / mass)

    best, best_gap = -1, np.inf
    for t in range(BINS):
        pb, pf = cum[t], 1.0 - cum[t]
        if pb <= 0 or pf <= 0:
            continue
        back = information(p[1:t + 1], p[1:t + 1][::-1], pb)
        fore = information(p[t + 1:], p[t + 1:], pf)
        if abs(back - fore) < best_gap:
            best, best_gap = t, abs(back - fore)
    return best


def _two_peaks(c: np.ndarray):
    """Histogram smoothed by three-bin means until two peaks remain, with its peaks."""
    h = c.astype(float)
    for _ in range(10000):
        peaks = np.flatnonzero((h[:-2] < h[1:-1]) & (h[2:] < h[1:-1])) + 1
        if peaks.size <= 2:
            return (h, peaks) if peaks.size == 2 else (None, None)
        padded = np.concatenate((h[:1], h, h[-1:]))
        h = (padded[:-2] + padded[1:-1] + padded[2:]) / 3.0
    return None, None


def _minimum(c: np.ndarray) -> int:
    h, _ = _two_peaks(c)
    if h is None:
        return -1
    valley = np.flatnonzero((h[:-2] > h[1:-1]) & (h[2:] >= h[1:-1]))
    return int(valley[0]) + 1 if valley.size else -1


def _intermodes(c: np.ndarray) -> int:
    h, peaks = _two_peaks(c)
    return -1 if h is None else int((peaks[0] + peaks[1]) // 2)


_ARRAY_METHODS = {"isodata": _isodata, "li": _li, "huang": _huang, "shanbhag": _shanbhag,
                  "minimum": _minimum, "intermodes": _intermodes}
_WINDOW_METHODS = {"otsu": otsu, "triangle": triangle, "yen": yen, "max_entropy": max_entropy,
                   "mean": mean, "moments": moments, "percentile": percentile}
METHODS = (*_WINDOW_METHODS, *_ARRAY_METHODS)


def auto_threshold(hist: DataFrame, method: str, keys: list[str] = PLANE) -> DataFrame:
    """Any method by name on sparse histogram rows; an unknown name means Otsu.

    Adds ``threshold``, the upper edge of the chosen bin (NULL when the bin is -1).
    """
    if method in _ARRAY_METHODS:
        kernel = _ARRAY_METHODS[method]

        @F.pandas_udf("int")
        def pick(counts: pd.Series) -> pd.Series:
            return counts.map(lambda c: kernel(np.asarray(c, dtype=np.int64)))

        out = histogram_arrays(hist, keys).withColumn("threshold_bin", pick("counts")).drop("counts")
    else:
        chosen = _WINDOW_METHODS.get(method, otsu)
        out = chosen(dense(hist, keys, all_bins=chosen in (triangle, yen, percentile)), keys)
    return out.withColumn("threshold", upper_edge(F.col("threshold_bin"), F.col("lo"), F.col("hi")))


def upper_edge(bin_: Column, lo: Column, hi: Column) -> Column:
    """Value a threshold bin stands for: its upper edge."""
    return F.when(bin_ >= 0, lo + (bin_ + 1) / F.lit(float(BINS)) * (hi - lo))


def stability_bins(samples: int = 64) -> list[int]:
    """Evenly spread threshold bins, 8 to 128 of them."""
    k = int(clamp_int(samples, 8, 128))
    return [int(np.floor(i / (k - 1.0) * (BINS - 1.0) + 0.5)) for i in range(k)]


def clamp_int(v: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, v))


def widest_plateau(curve: DataFrame) -> DataFrame:
    """Suggested bin of each stability curve: middle of the longest run of steady counts.

    A run lasts while the count stays within max(1, 10 %) of its first point and counts
    only when its middle point selects something (0.0005 < area < 0.95). The curve is an
    array of at most 128 points, folded in place.
    """
    pts = F.sort_array(F.collect_list(F.struct("bin_index", "bin", "object_count", "area_fraction")))
    g = curve.groupBy(*PLANE).agg(pts.alias("p"))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"), F.lit(0).alias("len"))

    def step(acc, i):
        size = F.size("p")
        first = F.element_at("p", acc["run"] + 1)["object_count"].cast("double")
        here = F.get(F.col("p"), i)["object_count"].cast("double")
        ended = (i >= size) | F.coalesce(F.abs(here - first) > F.greatest(F.lit(1.0), first * 0.1), F.lit(True))
        length = i - acc["run"]
        mid = F.element_at("p", F.least(acc["run"] + F.floor(length / 2).cast("int"), size - 1) + 1)
        usable = (mid["object_count"] > 0) & (mid["area_fraction"] > 0.0005) & (mid["area_fraction"] < 0.95)
        better = ended & usable & (length > acc["len"])
        return F.struct(F.when(ended, i).otherwise(acc["run"]).cast("int").alias("run"),
                        F.when(better, acc["run"]).otherwise(acc["best"]).cast("int").alias("best"),
                        F.when(better, length).otherwise(acc["len"]).cast("int").alias("len"))

    # The last step closes the final run; its start may lie past the end, hence the guard.
    g = g.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.size("p")), start, step))
    idx = F.when(F.col("a.len") > 0, F.col("a.best") + F.floor(F.col("a.len") / 2)).otherwise(
        F.floor(F.size("p") / 2)).cast("int")
    return g.select(*PLANE, F.element_at("p", idx + 1)["bin"].alias("suggested_bin"),
                    F.col("a.len").alias("plateau_width"))

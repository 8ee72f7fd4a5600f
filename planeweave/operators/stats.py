"""Image, channel and histogram aggregates. All of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions.numeric import clamp, finite, half_up, nan, only_finite
from planeweave.functions.values import _channel_value
from planeweave.schema import MEASURED_KEYS, PIXEL, PLANE

BINS = 256


def plane_headers(samples: DataFrame) -> DataFrame:
    """Channel count and extent of each plane found in the samples."""
    return samples.groupBy(*PLANE).agg(
        (F.max("channel") + 1).alias("channels"), (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"))


def image_stats(samples: DataFrame) -> DataFrame:
    """min, max, mean, population std, valid, non-finite and total count per plane.

    Only channel 0 counts when there are one or two channels, else the first three. Both
    variants are summed in the same pass and chosen at the end, so there is one shuffle of
    partial sums and no second scan for the channel count.
    """
    ok, v, ch = finite("value"), F.col("value"), F.col("channel")
    aggs = [F.max("channel").alias("_mc")]
    for tag, scanned in (("a", ch < 1), ("b", ch < 3)):
        use = F.when(scanned & ok, v)
        aggs += [F.min(use).alias(f"min_{tag}"), F.max(use).alias(f"max_{tag}"),
                 F.sum(use).alias(f"sum_{tag}"), F.sum(use * use).alias(f"sq_{tag}"),
                 F.count(use).alias(f"n_{tag}"), F.count(F.when(scanned, F.lit(1))).alias(f"t_{tag}")]
    g = samples.groupBy(*PLANE).agg(*aggs)

    def pick(name: str) -> Column:
        return F.when(F.col("_mc") < 2, F.col(f"{name}_a")).otherwise(F.col(f"{name}_b"))

    g = g.select(*PLANE, *[pick(n).alias(n) for n in ("min", "max", "sum", "sq", "n", "t")])
    mean = F.col("sum") / F.nullif(F.col("n"), F.lit(0))
    var = F.greatest(F.col("sq") / F.nullif(F.col("n"), F.lit(0)) - mean * mean, F.lit(0.0))
    return g.select(*PLANE, "min", "max", mean.alias("mean"), F.sqrt(var).alias("std"),
                    F.col("n").alias("valid_count"), (F.col("t") - F.col("n")).alias("non_finite_count"),
                    F.col("t").alias("total_count"))


def channel_ranges(samples: DataFrame) -> DataFrame:
    """Finite min, max and counts per channel; a channel without finite samples spans 0..1."""
    use = only_finite("value")
    g = samples.groupBy(*PLANE, "channel").agg(
        F.min(use).alias("min"), F.max(use).alias("max"), F.count(use).alias("count"),
        F.count(F.lit(1)).alias("_t"))
    return g.select(*PLANE, "channel", F.coalesce("min", F.lit(0.0)).alias("min"),
                    F.coalesce("max", F.lit(1.0)).alias("max"), "count",
                    (F.col("_t") - F.col("count")).alias("non_finite_count"))


def floor_bin(v: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """Equal-width bin, clamped to the ends; a constant plane falls into bin 0."""
    scale = F.try_divide(F.lit(float(bins)), hi - lo)
    return F.when(hi == lo, F.lit(0)).otherwise(
        clamp(F.floor((v - lo) * scale), F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).cast("int")


def _sampled(plane: DataFrame, step: int, planes: DataFrame | None) -> DataFrame:
    if step <= 1:
        return plane
    widths = (planes if planes is not None else plane_headers(plane)).select(*PLANE, "width")
    return plane.join(widths, PLANE).where(
        (F.col("y").cast("long") * F.col("width") + F.col("x")) % step == 0).drop("width")


def histogram(plane: DataFrame, step: int = 1, planes: DataFrame | None = None,
              keys: list[str] = PLANE) -> DataFrame:
    """256-bin histogram as ``(keys, lo, hi, bin, n)``; only non-empty bins have rows.

    ``step`` keeps every step-th pixel in raster order. The range is an aggregate joined
    back (one row per plane; Spark broadcasts it when its measured size permits and splits
    hot planes otherwise); the count combines per task before its shuffle.
    """
    used = _sampled(plane, step, planes).where(finite("value"))
    rng = used.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return (used.join(rng, list(keys))
            .select(*keys, "lo", "hi", floor_bin(F.col("value"), F.col("lo"), F.col("hi")).alias("bin"))
            .groupBy(*keys, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n")))


def histogram_header(plane: DataFrame) -> DataFrame:
    """Range and counts that accompany a histogram; 0..0 when nothing is finite."""
    use = only_finite("value")
    return plane.groupBy(*PLANE).agg(
        F.coalesce(F.min(use), F.lit(0.0)).alias("min"), F.coalesce(F.max(use), F.lit(0.0)).alias("max"),
        F.count(use).alias("total"), (F.count(F.lit(1)) - F.count(use)).alias("non_finite_count"))


def display_curve(value: Column, gamma_in: float, gamma_out: float, stops: float) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.pow(value, F.lit(gamma_in)) * F.lit(2.0 ** stops)),
                 F.lit(1.0 / gamma_out))


def _trunc_bin(t: Column) -> Column:
    return clamp(t.cast("long"), F.lit(0).cast("long"), F.lit(255).cast("long")).cast("int")


def display_histogram(samples: DataFrame, ranges: DataFrame, gamma: tuple | None = None) -> DataFrame:
    """Red, green, blue and luminance counts per display bin.

    A pixel with any non-finite channel is dropped. Absent channels repeat the first.
    ``ranges`` gives ``lo, hi`` per plane. With ``gamma = (in, out, stops)`` the value is
    quantised to 16 bits, sent through the curve and truncated. Bins truncate rather than floor.
    Each channel is one row of a small array exploded before a single count, so the three
    histograms come out of one shuffle.
    """
    px = samples.where(F.col("channel") < 3).groupBy(*PIXEL).agg(
        *[_channel_value(i).alias(n) for i, n in enumerate("rgb")],
        F.max("channel").alias("_mc"))
    r = F.col("r")
    g = F.when(F.col("_mc") >= 1, F.col("g")).otherwise(r)
    b = F.when(F.col("_mc") >= 2, F.col("b")).otherwise(r)
    px = px.where(finite(r) & finite(g) & finite(b)).join(ranges, PLANE)
    span = F.col("hi") - F.col("lo")
    inv = F.when(span > 0, F.try_divide(F.lit(1.0), span)).otherwise(F.lit(0.0))

    def bin_of(v: Column) -> Column:
        if gamma is None:
            return _trunc_bin((v - F.col("lo")) * inv * 255)
        q = clamp(((v - F.col("lo")) * inv * 65535).cast("long"), F.lit(0).cast("long"),
                  F.lit(65535).cast("long"))
        return _trunc_bin(display_curve(q / F.lit(65535.0), *gamma) * 255)

    flat = px.select(*PLANE, F.posexplode(F.array(bin_of(r), bin_of(g), bin_of(b))).alias("c", "bin"))
    per = flat.groupBy(*PLANE, "bin").agg(
        *[F.count(F.when(F.col("c") == i, 1)).alias(n) for i, n in enumerate("rgb")])
    # Luminance copies the histogram of a gray plane, else weights the three counts.
    gray = F.min(((F.col("r") == F.col("g")) & (F.col("r") == F.col("b"))).cast("int")).over(
        Window.partitionBy(*PLANE))  # at most 256 rows per plane
    lum = F.when(gray == 1, F.col("r")).otherwise(
        half_up(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("long"))
    return per.select(*PLANE, "bin", "r", "g", "b", lum.alias("luminance"))


def bin_stats(hist: DataFrame, count: str = "luminance") -> DataFrame:
    """First and last non-empty bin, mean bin and total of one histogram column."""
    n = F.col(count)
    used = F.when(n > 0, F.col("bin"))
    return hist.groupBy(*PLANE).agg(
        F.coalesce(F.min(used), F.lit(0)).alias("min_bin"), F.coalesce(F.max(used), F.lit(255)).alias("max_bin"),
        F.coalesce(F.try_divide(F.sum(F.col("bin") * n), F.sum(n)), F.lit(0.0)).alias("mean_bin"),
        F.sum(n).alias("total"))


def channel_histograms(samples: DataFrame, settings: DataFrame) -> DataFrame:
    """Per-channel counts on each channel's own display range; outliers land in the end bins."""
    span = F.col("hi") - F.col("lo")
    scale = F.when(span != 0, F.try_divide(F.lit(256.0), span)).otherwise(F.lit(0.0))
    b = clamp(F.floor((F.col("value") - F.col("lo")) * scale), F.lit(0).cast("long"), F.lit(255).cast("long"))
    return (samples.where(finite("value")).join(settings, [*PLANE, "channel"])
            .select(*PLANE, "channel", b.cast("int").alias("bin"))
            .groupBy(*PLANE, "channel", "bin").agg(F.count(F.lit(1)).alias("n")))


def auto_range(samples: DataFrame, low: float = 0.001, high: float = 0.999, bins: int = 4096) -> DataFrame:
    """Display range that clips a small fraction at both ends of each channel."""
    key = [*PLANE, "channel"]
    stats = channel_ranges(samples).select(*key, "min", "max", "count")
    counts = (samples.where(finite("value")).join(stats, key)
              .groupBy(*key, floor_bin(F.col("value"), F.col("min"), F.col("max"), bins).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    run = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("cum", F.sum("n").over(run)).join(stats.select(*key, "count"), key)
    edge = cum.groupBy(*key).agg(
        F.min(F.when(F.col("cum") >= F.col("count") * low, F.col("bin"))).alias("_b0"),
        F.min(F.when(F.col("cum") >= F.col("count") * high, F.col("bin"))).alias("_b1"))
    lo, hi, span = F.col("min"), F.col("max"), F.col("max") - F.col("min")
    # A low target of zero is met by bin 0 even when that bin is empty; bin 0 holds the minimum.
    a = lo + F.col("_b0") / F.lit(float(bins)) * span
    b = lo + (F.col("_b1") + 1) / F.lit(float(bins)) * span
    flat = (F.col("count") == 0) | (hi == lo)
    top = F.when(hi == 0, lo + 1).otherwise(hi)
    return stats.join(edge, key, "left").select(
        *key, F.when(flat, lo).otherwise(a).alias("lo"),
        F.when(flat, top).when(b > a, b).otherwise(a + span / bins).alias("hi"))


def difference_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean and maximum absolute error over all samples and the share of differing pixels.

    A pixel differs when any channel differs by more than one. A sample on one side only
    is compared with zero.
    """
    key = [*PIXEL, "channel"]
    d = left.select(*key, F.col("value").alias("a")).join(
        right.select(*key, F.col("value").alias("b")), key, "full")
    err = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    px = d.groupBy(*PIXEL).agg(F.sum(err).alias("s"), F.max(err).alias("m"), F.count(F.lit(1)).alias("k"))
    return px.groupBy(*PLANE).agg(
        (F.sum("s") / F.sum("k")).alias("mean_abs_error"), F.max("m").alias("max_abs_error"),
        F.avg((F.col("m") > 1).cast("double")).alias("differing_ratio"))


def box_downsample(plane: DataFrame, planes: DataFrame, max_pixels: int) -> DataFrame:
    """Box averages of finite values on at most ``max_pixels`` cells; remainders are dropped."""
    px = F.col("width").cast("double") * F.col("height")
    factor = F.when(px <= max_pixels, F.lit(1)).otherwise(F.ceil(F.sqrt(px / max_pixels))).cast("int")
    hdr = planes.select(*PLANE, factor.alias("f"),
                        F.greatest(F.floor(F.col("width") / factor), F.lit(1)).cast("int").alias("ow"),
                        F.greatest(F.floor(F.col("height") / factor), F.lit(1)).cast("int").alias("oh"))
    cell = plane.join(hdr, PLANE).select(
        *PLANE, F.expr("cast(y div f as int)").alias("y"), F.expr("cast(x div f as int)").alias("x"),
        "value", "ow", "oh").where((F.col("y") < F.col("oh")) & (F.col("x") < F.col("ow")))
    return cell.groupBy(*PIXEL).agg(
        F.coalesce(F.avg(only_finite("value")), nan()).cast("float").cast("double").alias("value"))


def group_summary(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """n, mean, sample sd, standard error, min and max of one column per group."""
    v = only_finite(F.expr(f"try_cast(`{column}` as double)"))
    g = rows.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    return g.where(F.col("n") > 0).withColumn("sem", F.col("sd") / F.sqrt(F.col("n").cast("double")))


def summary_all(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Group summary of every numeric column that is no key of a measurement row."""
    numeric = [n for n, t in rows.dtypes
               if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and n not in (*MEASURED_KEYS, *keys)]
    # Narrow to a common type, then turn columns into rows: values stay in one pass.
    long = rows.select(*keys, *[F.col(n).cast("double").alias(n) for n in numeric]).unpivot(
        list(keys), numeric, "column", "value")
    return group_summary(long, [*keys, "column"], "value")


def coverage_range(samples: DataFrame) -> DataFrame:
    """Range of a composite over its covered, finite pixels, with their count."""
    v = F.when(F.col("covered"), only_finite("value"))
    return samples.groupBy(*PLANE).agg(
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"),
        F.count(F.when(F.col("covered"), 1)).alias("covered_count"))

"""Decoding and shaping of stored sample values (columns in, columns out)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.numeric import col, f32, finite, nan
from planeweave.schema import PIXEL, PLANE


def rescale(stored: Column | str, scale, offset, fill: Column | Sequence[float] | None = None) -> Column:
    """``offset + scale * stored``; a stored value found in ``fill`` becomes NaN.

    Fill values are compared before scaling. The result passes through single precision.
    """
    s = col(stored)
    value = f32(_lit(offset) + _lit(scale) * s)
    if fill is None:
        return value
    fills = fill if isinstance(fill, Column) else F.array(*[F.lit(float(v)) for v in fill])
    return F.when(F.coalesce(F.array_contains(fills, s), F.lit(False)), nan()).otherwise(value)


def _lit(v):
    return v if isinstance(v, Column) else F.lit(float(v))


def invert_planes(samples: DataFrame, keys: Sequence[str] = PLANE) -> DataFrame:
    """``max + min - v`` per frame; the two facts are aggregates joined back."""
    facts = samples.groupBy(*keys).agg(
        F.max(F.when(finite("value"), F.col("value"))).alias("_hi"),
        F.min(F.when(finite("value"), F.col("value"))).alias("_lo"))
    return (samples.join(facts, list(keys))
            .withColumn("value", F.col("_hi") + F.col("_lo") - F.col("value")).drop("_hi", "_lo"))


def stored_bits(raw: Column | str, bits: int, signed: bool) -> Column:
    """Keep the low ``bits`` of an integer and read them as two's complement if signed."""
    kept = col(raw).cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    if not signed:
        return kept
    return F.when(kept >= F.lit(1 << (bits - 1)), kept - F.lit(1 << bits)).otherwise(kept)


def scaled_domain(stored_min, stored_max, scale, offset) -> tuple[Column, Column]:
    """Lower and upper end of the value domain after a linear rescale."""
    a, b = (_lit(offset) + _lit(scale) * _lit(e) for e in (stored_min, stored_max))
    return F.least(a, b), F.greatest(a, b)


def nodata_from_tags(tags: DataFrame) -> DataFrame:
    """First finite nodata sentinel of each image in its long tag table.

    Matched by tag number 42113, by that number inside an ``Unknown(...)`` name, or by a
    name containing "nodata".
    """
    number = F.regexp_extract(F.lower("name"), r"unknown\((\d+)\)", 1)
    # Leading numeric prefix, the way loose number parsing reads a text value.
    text = F.regexp_extract(F.col("value"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    hit = tags.where(
        F.lower("name").contains("nodata") | (F.col("tag") == 42113) | (number == "42113")
    ).withColumn("_v", F.when(text != "", text.cast("double")))
    return (hit.where(finite("_v")).groupBy("image_id")
            .agg(F.min_by("_v", F.col("tag_order")).alias("nodata")))


def drop_nodata(samples: DataFrame, nodata: DataFrame) -> DataFrame:
    """Exclude samples equal to their image's nodata value."""
    return (samples.join(nodata, "image_id", "left")
            .where(F.col("nodata").isNull() | (F.col("value") != F.col("nodata"))).drop("nodata"))


def _channel_value(c: int) -> Column:
    return F.max(F.when(F.col("channel") == c, F.col("value")))


def rgb24(samples: DataFrame) -> DataFrame:
    """First three channels packed into one 24-bit number per pixel."""
    r, g, b = (F.floor(F.col(n)).cast("long") for n in "rgb")
    return (samples.where((F.col("channel") < 3) & finite("value")).groupBy(*PIXEL)
            .agg(*[_channel_value(i).alias(n) for i, n in enumerate("rgb")])
            .where(F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull())
            .select(*PIXEL, F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b).alias("value24")))


# Rec. 709 luma weights (fixed values).
LUMA_WEIGHTS = (0.2126, 0.7152, 0.0722)


def scalar_plane(samples: DataFrame) -> DataFrame:
    """One value per pixel: itself, the mean of two channels, or luma of the first three.

    NaN in a used channel makes the pixel NaN. One shuffle on the pixel key.
    """
    wr, wg, wb = LUMA_WEIGHTS
    px = samples.groupBy(*PIXEL).agg(
        *[_channel_value(i).alias(f"_{n}") for i, n in enumerate("rgb")],
        (F.max("channel") + 1).alias("_n"))
    value = (F.when(F.col("_n") == 1, F.col("_r"))
             .when(F.col("_n") == 2, (F.col("_r") + F.col("_g")) / 2)
             .otherwise(F.lit(wr) * F.col("_r") + F.lit(wg) * F.col("_g") + F.lit(wb) * F.col("_b")))
    return px.select(*PIXEL, F.lit(0).alias("channel"), value.alias("value"))


def flip_vertical(samples: DataFrame, planes: DataFrame) -> DataFrame:
    """Mirror the lines of each plane (formats that store the bottom line first)."""
    return (samples.join(planes.select(*PLANE, "height"), PLANE)
            .withColumn("y", F.col("height") - 1 - F.col("y")).drop("height"))


def value_window(samples: DataFrame, low, high) -> DataFrame:
    """Mask rows: finite samples inside the closed interval."""
    v = F.col("value")
    return samples.where(finite(v) & (v >= _lit(low)) & (v <= _lit(high)))


CONDITIONS = ("gt", "ge", "lt", "le", "eq", "isfinite", "isnan")


def keep_condition(value: Column | str, op: str | None, threshold: float = 0.0) -> Column:
    """Predicate that keeps the content below a mask pixel; unknown or absent keeps all.

    Spark orders NaN above every number, so comparisons are guarded to be false on NaN.
    """
    v, t = col(value), F.lit(float(threshold))
    number = ~F.isnan(v)
    return {
        "gt": number & (v > t), "ge": number & (v >= t),
        "lt": number & (v < t), "le": number & (v <= t), "eq": number & (v == t),
        "isfinite": finite(v), "isnan": ~finite(v),
    }.get(op, F.lit(True))


def inspect_points(samples: DataFrame, points: DataFrame) -> DataFrame:
    """All channel values at given pixels; points off the plane have no rows to join."""
    return points.join(samples, PIXEL).groupBy("point_id", *PIXEL).agg(
        F.sort_array(F.collect_list(F.struct("channel", "value"))).alias("_s")
    ).select("point_id", *PIXEL, F.transform("_s", lambda s: s["value"]).alias("values"))


def select_planes(samples: DataFrame, **coordinates: int | Sequence[int]) -> DataFrame:
    """Filter on plane keys; on a partitioned table this prunes files before reading."""
    for name, want in coordinates.items():
        wanted = list(want) if isinstance(want, (list, tuple, set, range)) else [want]
        samples = samples.where(F.col(name).isin(wanted))
    return samples


def default_channel_name(index: Column | str, count: Column | str) -> Column:
    """Red/Green/Blue/Alpha for 3 or 4 channels, numbered names otherwise."""
    i, n = col(index), col(count)
    rgba = F.array(*[F.lit(s) for s in ("Red", "Green", "Blue", "Alpha")])
    return F.when(n.isin(3, 4) & (i < 4), F.get(rgba, i)).otherwise(
        F.concat(F.lit("Channel "), (i + 1).cast("string")))


def deinterleave(lines: DataFrame) -> DataFrame:
    """Interleaved lines ``(…, y, channels, data array)`` to long samples with channel names."""
    return lines.select(
        *PLANE, "y", "channels", F.posexplode("data").alias("_p", "value")
    ).select(
        *PLANE, F.expr("cast(pmod(_p, channels) as int)").alias("channel"), "y",
        F.expr("cast(_p div channels as int)").alias("x"),
        F.col("value").cast("double").alias("value"),
        default_channel_name(F.expr("cast(pmod(_p, channels) as int)"), "channels").alias("channel_name"))

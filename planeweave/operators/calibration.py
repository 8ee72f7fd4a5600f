"""Physical pixel sizes from file metadata or a known distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.numeric import finite


def leading_number(text: Column) -> Column:
    """Numeric prefix of a text, NULL without one."""
    m = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(m != "", m.cast("double"))


def _calibration(w: Column, h: Column, depth: Column, unit: Column, origin: Column) -> Column:
    return F.struct(w.alias("pixel_width"), h.alias("pixel_height"), depth.cast("double").alias("pixel_depth"),
                    unit.alias("unit"), origin.alias("origin"))


def _tag_number(text: Column) -> Column:
    """A tag value; "300, 1" is a rational."""
    parts = F.split(text, ",")
    a, b = leading_number(F.get(parts, 0)), leading_number(F.get(parts, 1))
    return F.when(b.isNotNull() & (b != 0), F.try_divide(a, b)).otherwise(a)


def from_resolution_tags(tags: DataFrame) -> DataFrame:
    """Reciprocal of pixels per unit; unit "none" and the 1 x 1 default are rejected."""
    n = F.lower("name")
    g = tags.where(n.isin("xresolution", "yresolution", "resolutionunit")).groupBy("image_id").agg(*[
        F.max(F.when(n == k, _tag_number(F.col("value")))).alias(k) for k in ("xresolution", "yresolution", "resolutionunit")])
    x, y = F.col("xresolution"), F.col("yresolution")
    u = F.coalesce("resolutionunit", F.lit(2.0))
    unit = F.when(u == 2, F.lit("inch")).when(u == 3, F.lit("cm"))
    ok = (x > 0) & (y > 0) & unit.isNotNull() & ~((x == 1) & (y == 1))
    return g.select("image_id", F.when(ok, _calibration(
        F.try_divide(F.lit(1.0), x), F.try_divide(F.lit(1.0), y), F.lit(None), unit, F.lit("tiff-resolution"))).alias("cal"))


def from_ome(ome: DataFrame) -> DataFrame:
    """Declared physical sizes; axes with different units are rejected."""
    x, y = F.col("size_x"), F.col("size_y")
    ux = F.coalesce(F.when(F.col("unit_x") != "", F.col("unit_x")), F.lit("µm"))
    uy = F.coalesce(F.when(F.col("unit_y") != "", F.col("unit_y")), ux)
    ok = finite(x) & finite(y) & (x > 0) & (y > 0) & (ux == uy)
    return ome.select("image_id", F.when(ok, _calibration(x, y, F.col("size_z"), ux, F.lit("ome"))).alias("cal"))


def from_dicom(headers: DataFrame) -> DataFrame:
    r"""``row\column`` spacing in mm (row spacing is the height); detector spacing as fallback."""
    def values(c: str) -> Column:
        nums = F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\\"), leading_number)
        return F.filter(nums, lambda v: finite(v) & (v > 0))

    d = headers.select("image_id", values("pixel_spacing").alias("p"), values("imager_pixel_spacing").alias("d"),
                       F.coalesce(F.get(values("spacing_between_slices"), 0), F.get(values("slice_thickness"), 0)).alias("z"))
    patient = F.size("p") >= 2
    s = F.when(patient, F.col("p")).when(F.size("d") >= 2, F.col("d"))
    origin = F.when(patient, F.lit("dicom")).otherwise(F.lit("dicom-detector"))
    return d.select("image_id", F.when(s.isNotNull(), _calibration(
        F.get(s, 1), F.get(s, 0), F.col("z"), F.lit("mm"), origin)).alias("cal"))


def from_scaling(rows: DataFrame) -> DataFrame:
    """Micrometre scaling factors; a missing height repeats the width."""
    def positive(c: str) -> Column:
        return F.when(finite(c) & (F.col(c) > 0), F.col(c))

    w = positive("scaling_x_um")
    h = F.coalesce(positive("scaling_y_um"), w)
    return rows.select("image_id", F.when(w.isNotNull(), _calibration(
        w, h, positive("scaling_z_um"), F.lit("µm"), F.lit("czi"))).alias("cal"))


def auto_calibration(images: DataFrame, **sources: DataFrame) -> DataFrame:
    """Best calibration per image in the given order of sources; pixels when none is valid."""
    out = images.select("image_id")
    for name, cal in sources.items():
        out = out.join(cal.withColumnRenamed("cal", f"_{name}"), "image_id", "left")
    none = _calibration(F.lit(1.0), F.lit(1.0), F.lit(None), F.lit("px"), F.lit("none"))
    return out.select("image_id", F.coalesce(*[F.col(f"_{n}") for n in sources], none).alias("cal")).select("image_id", "cal.*")


def from_known_distance(pixel_distance: Column, known_length: Column, unit: Column) -> Column:
    """Square pixel size from a line of known length; NULL unless both are positive."""
    ok = (pixel_distance > 0) & (known_length > 0)
    size = F.when(ok, F.try_divide(known_length, pixel_distance))
    u = F.coalesce(F.when(unit != "", unit), F.lit("px"))
    return F.when(ok, _calibration(size, size, F.lit(None), u, F.lit("manual")))

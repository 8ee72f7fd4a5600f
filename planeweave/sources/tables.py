"""Tables around measurement: sidecars, tags, run-length masks, exports, accumulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions.text import number_text

SIDECAR_VERSION = 2
ROI_FIELDS = (
    "id bigint, kind string, name string, `group` string, page int, x double, y double, "
    "width double, height double, angle double, lineWidth double, points array<double>, maskRuns array<int>")


def read_sidecars(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROI rows and warnings from ``(image_id, text)`` JSON sidecars.

    Entries are parsed one by one from raw JSON, so one bad entry costs only itself.
    """
    raw = texts.select(
        "image_id", F.try_parse_json("text").isNotNull().alias("readable"), "text",
        F.get_json_object("text", "$.version").cast("double").alias("version"),
        F.from_json(F.get_json_object("text", "$.rois"), "array<string>").alias("entries"))
    has_list = F.col("readable") & F.get_json_object("text", "$.rois").startswith("[")
    entries = raw.where(has_list).select(
        "image_id", F.posexplode("entries").alias("position", "entry")
    ).select("image_id", "position", F.from_json("entry", ROI_FIELDS).alias("r"))
    mask_ok = (F.col("r.maskRuns").isNotNull()
               & (F.coalesce(F.col("r.width") * F.col("r.height"), F.lit(0.0)) > 0))
    ok = F.coalesce(F.col("r.kind") != "", F.lit(False)) & ((F.col("r.kind") != "mask") | mask_ok)
    rois = entries.where(ok).select("image_id", "position", "r.*")
    skipped = entries.where(~ok).select("image_id", F.lit("unreadable_entry").alias("warning"))
    file_level = raw.select("image_id", F.when(~F.col("readable"), F.lit("unreadable_file"))
                            .when(~F.coalesce(has_list, F.lit(False)), F.lit("no_rois"))
                            .when(F.col("version") > SIDECAR_VERSION, F.lit("newer_version")).alias("warning")
                            ).where(F.col("warning").isNotNull())
    return rois, skipped.unionByName(file_level)


def write_sidecars(rois: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON document per image; the document is by definition one image's ROI list."""
    fields = [c for c in rois.columns if c != "image_id"]
    docs = rois.groupBy("image_id").agg(F.to_json(F.struct(
        F.lit(SIDECAR_VERSION).alias("version"), F.first("image_id").alias("image"),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("rois"))).alias("text"))
    if path is not None:
        docs.write.mode("overwrite").partitionBy("image_id").text(path)
    return docs


def tag_rows(objects: DataFrame, group: str, json: str = "json", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Nested JSON objects as ``(keys, tag_group, name, value)`` rows with dotted names.

    Each level explodes the maps of the level before, until no value is an object; a job per level
    asks whether there is a next. Absent values give no row, lists become comma-separated text.
    """
    level = objects.select(*keys, F.lit("").alias("prefix"), F.col(json).alias("v"))
    nested, out = F.col("v").startswith("{"), None
    while out is None or level.limit(1).count():
        kids = level.select(*keys, "prefix", F.explode(F.from_json("v", "map<string,string>")).alias("k", "v")).select(
            *keys, F.when(F.col("prefix") == "", F.col("k")).otherwise(F.concat_ws(".", "prefix", "k")).alias("prefix"), "v"
        ).where(F.col("v").isNotNull())
        leaves = kids.where(~nested)
        out = leaves if out is None else out.unionByName(leaves)
        level = kids.where(nested)
    as_list = F.array_join(F.from_json("v", "array<string>"), ", ")
    value = F.when(F.col("v").startswith("["), as_list).otherwise(F.col("v"))
    return out.select(*keys, F.lit(group).alias("tag_group"), F.col("prefix").alias("name"), value.alias("value"))


# --- run-length masks --------------------------------------------------------------------


def spans_of(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Horizontal runs of mask pixels; each window holds one line of one object."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    isle = pixels.select(*keys, "y", "x", (F.col("x") - F.row_number().over(w)).alias("_g"))
    return isle.groupBy(*keys, "y", "_g").agg(
        F.min("x").alias("x_start"), F.max("x").alias("x_end")).drop("_g")


def encode_runs(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box and alternating run lengths (zeros first) of each object's mask.

    Pixels shrink to line spans before anything is ordered per object, so the ordered part
    is as long as the resulting array, not as the object.
    """
    spans = spans_of(pixels, keys)
    boxes = spans.groupBy(*keys).agg(
        F.min("x_start").alias("x"), F.min("y").alias("y"),
        (F.max("x_end") - F.min("x_start") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    s = spans.withColumnRenamed("y", "_y").join(boxes, list(keys)).select(
        *keys, "x", "y", "width", "height",
        ((F.col("_y") - F.col("y")).cast("long") * F.col("width") + F.col("x_start") - F.col("x")).alias("a"),
        ((F.col("_y") - F.col("y")).cast("long") * F.col("width") + F.col("x_end") - F.col("x")).alias("b"))
    w = Window.partitionBy(*keys).orderBy("a")
    s = s.withColumn("_new", (F.col("a") != F.lag("b", 1, -2).over(w) + 1).cast("int"))
    s = s.withColumn("_isle", F.sum("_new").over(w))
    runs = s.groupBy(*keys, "x", "y", "width", "height", "_isle").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    g = runs.groupBy(*keys, "x", "y", "width", "height").agg(
        F.sort_array(F.collect_list(F.struct("a", "b"))).alias("r"))
    gaps = F.transform("r", lambda e, i: F.array(
        e["a"] - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("r"), i - 1)["b"] + 1), e["b"] - e["a"] + 1))
    size = F.col("width").cast("long") * F.col("height")
    tail = size - 1 - F.element_at("r", -1)["b"]
    flat = F.flatten(gaps)
    return g.select(*keys, "x", "y", "width", "height", F.transform(
        F.when(tail > 0, F.concat(flat, F.array(tail))).otherwise(flat), lambda v: v.cast("int")).alias("runs"))


def decode_runs(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mask pixels of ``(keys, x, y, width, height, runs)``; runs past the box are dropped."""
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    r = masks.select(*keys, "x", "y", "width", "height", F.posexplode("runs").alias("p", "n"))
    size = F.col("width").cast("long") * F.col("height")
    r = r.withColumn("a", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")))
    r = r.where((F.col("p") % 2 == 1) & (F.col("n") > 0) & (F.col("a") < size))
    i = r.withColumn("i", F.explode(F.sequence("a", F.least(F.col("a") + F.col("n"), size) - 1)))
    return i.select(*keys, (F.col("y") + F.expr("cast(i div width as int)")).alias("y"),
                    (F.col("x") + F.expr("cast(i % width as int)")).alias("x"))


# --- results -----------------------------------------------------------------------------


def append_results(results: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Results of several images in one table; columns absent on one side are NULL there."""
    return results.unionByName(new_rows, allowMissingColumns=True)


def replace_images(results: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Keep the latest rows per image: an image measured again loses its old rows."""
    kept = results.join(new_rows.select("image_id").distinct(), "image_id", "left_anti")
    return append_results(kept, new_rows)


PROVENANCE = ("unit", "pixel_width", "pixel_height", "calibration_origin", "threshold_method",
              "threshold_low", "threshold_high", "preprocessing", "settings_hash")


def present_columns(rows: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Candidates with at least one value; one aggregate row comes back."""
    have = [c for c in candidates if c in rows.columns]
    hit = rows.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in have]).first()
    return [c for c in have if hit[c]]


def export_rows(rows: DataFrame, provenance: DataFrame, columns: Sequence[str], decimal: str = ".",
                precision: int = 6) -> DataFrame:
    """Measurement rows as text columns, each with the provenance of its own image."""
    def text(df: DataFrame, c: str):
        if dict(df.dtypes)[c] in ("double", "float", "int", "bigint", "smallint", "tinyint"):
            return number_text(c, precision, decimal).alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    # Spelled out once for each image, not for each of its rows; an image without provenance has empty text.
    prov = [c for c in PROVENANCE if c in provenance.columns]
    spelled = provenance.select(*[text(provenance, c) if c in prov else F.col(c) for c in provenance.columns])
    joined = rows.join(spelled, "image_id", "left")
    return joined.select(*[text(joined, c) for c in (*columns, *prov)])


def write_export(table: DataFrame, path: str, delimiter: str = ",", partition: str = "image_id") -> None:
    """Delimited files partitioned by image; quotes are doubled, only where needed."""
    (table.withColumn("_part", F.col(partition)).write.mode("overwrite").partitionBy("_part")
     .option("sep", delimiter).option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").option("nullValue", "").csv(path))

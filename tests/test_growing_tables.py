"""Steps whose memory or time once grew faster than their input."""

import math

from pyspark.sql import functions as F

from planeweave.functions.numeric import finite
from planeweave.operators import growth, layers as L, objects, rois
from planeweave.sources import tables as T, views


def test_filtered_grid_is_not_broadcast(spark):
    """A filter on finite values turns the outer join with the grid into an inner one."""
    planes = spark.createDataFrame([("i", 0, 2, 3, 2)], "image_id string, page int, channels int, width int, height int")
    cells = spark.createDataFrame([("i", 0, 1, 1, 2, 5.0), ("i", 0, 0, 0, 0, math.nan)],
                                  "image_id string, page int, channel int, y int, x int, value double")
    dense = views.densify(cells, planes)
    assert dense.count() == 12 and dense.where(F.isnan("value")).count() == 11
    kept = dense.where(finite("value"))
    assert [tuple(r)[2:] for r in kept.collect()] == [(1, 1, 2, 5.0)]
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def test_readers_of_covered_samples_build_no_grid(spark, tmp_path):
    """Queries that skip uncovered pixels read cells: the same finite samples, no multiplied rows, no broadcast of them."""
    from planeweave.plans.registry import QUERIES

    rows = [(5, 3, 1, 10.0), (5, 67, 1, 20.0), (4100, 9, 2, 7.0), (40000, 1, 3, None), (40001, 1, 3, 2.0), (-5, 3, 1, 1.0), (None, 3, 1, 1.0), (6, None, 1, 1.0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").withColumn(
        "l_extendedprice", F.lit(1.0)).write.parquet(f"{sf}/lineitem.parquet")
    dense = views.sparse_channels(spark, sf)
    key = ["image_id", "page", "channel", "y", "x", "value"]
    got = sorted(map(tuple, views.covered_channels(spark, sf).select(key).collect()))
    assert got == sorted(map(tuple, dense.where(finite("value")).select(key).collect())) and len(got) == 3
    heads = sorted(map(tuple, dense.where("image_id IS NOT NULL").groupBy("image_id", "page").agg(F.max("channel") + 1, F.max("x") + 1, F.max("y") + 1).collect()))
    assert sorted(map(tuple, views.channel_planes(spark, sf).collect())) == heads
    for name in ("p12_adjustments", "p12_colour_adjustments", "w1_gaussian_blur_sparse", "w7_local_otsu"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate explode(org.apache.spark.sql.catalyst.expressions.UnsafeArrayData" not in plan, name  # constant sequences of a grid


def _rects(spark, lefts):
    return spark.createDataFrame([(i, "i", 0, "rect", x, 0.0, 10.0, 10.0, 0.0, None) for i, x in lefts.items()],
                                 "roi_id long, image_id string, page int, kind string, x double, y double, width double, height double, angle double, points array<double>")


def test_nearest_roi_ties_to_nine_decimals(spark):
    """Distances that differ by rounding alone are a tie, also where one of them lies just beyond a ring."""
    point = spark.createDataFrame([(1, "i", 0, 0.0, 5.0)], "point_id long, image_id string, page int, px double, py double")
    for at, off in ((20.0, 1e-12), (64.0, 1e-11)):
        r = rois.nearest_roi(point, _rects(spark, {1: at + off, 2: at, 3: at + 1e-6}), first=64.0).first()
        assert (r["roi_id"], round(r["distance"], 6)) == (1, at)


def test_region_growing_spreads_seeds_and_bounds_batches(spark, monkeypatch):
    """Few bytes of seeds go to several tasks, and a kernel gets few rows with whole tiles at once."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, cut = spark.conf.get(name), growth.cut_lineage

    def watched(df):
        out = cut(df)
        if "costs" in df.columns:
            seen.append((spark.conf.get(name), out.select(F.spark_partition_id().alias("p")).distinct().count()))
        return out

    monkeypatch.setattr(growth, "cut_lineage", watched)
    plane = spark.range(16 * 16).select(F.lit("i").alias("image_id"), F.expr("cast(id div 16 as int)").alias("page"), F.lit(0).alias("y"),
                                        F.expr("cast(id % 16 as int)").alias("x"), F.expr("cast(id % 16 as double)").alias("value"))
    seeds = spark.range(16).select(F.lit("i").alias("image_id"), F.col("id").cast("int").alias("page"), F.col("id").alias("seed_id"), F.lit(0).alias("y"), F.lit(3).alias("x"))
    planes = spark.range(16).select(F.lit("i").alias("image_id"), F.col("id").cast("int").alias("page"), F.lit(16).alias("width"), F.lit(1).alias("height"))
    got = growth.grow_regions(seeds, plane, planes, tolerance=2.0).collect()
    assert len(got) == 16 and {(r["bx"], r["width"], r["area"], r["leaked"]) for r in got} == {(1, 5, 5, False)}
    assert seen[0][0] == str(growth.AT_ONCE) and seen[0][1] > 1
    assert spark.conf.get(name) == before


def test_unmasked_pixels_do_not_meet_in_one_task(spark):
    """Layers without a mask have no mask key; their pixels are dealt out like all others."""
    placed = spark.range(4096).select(F.expr("if(id % 64 = 0, 'm', 'u')").alias("layer_id"), F.expr("cast(id div 64 as int)").alias("y"), F.expr("cast(id % 64 as int)").alias("x"))
    masks = spark.createDataFrame([("m", 1, False, 0.5, 0, 2)], "layer_id string, mask_id int, invert boolean, mask_max double, mask_x int, mask_y int")
    at = spark.createDataFrame([(1, 1, 0, 0.25), (1, 2, 0, 9.0)], "mask_id int, y int, x int, value double").hint("merge")
    got = L.mask_factor(placed, masks.hint("broadcast"), at)
    rows = got.groupBy("layer_id", "factor", "masked").count().collect()
    assert sorted(tuple(r) for r in rows) == [("m", 0.0, True, 62), ("m", 0.5, True, 1), ("m", 1.0, True, 1), ("u", 1.0, False, 4032)]
    shares = [r["count"] for r in got.where("not masked").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 4 and max(shares) < 2 * 4032 / 4


def test_watershed_deals_pixels_to_tiles_once(spark):
    """Neighbours meet in tiles, not by nine copies of each pixel; ways and saddles go on across tile borders."""
    side = 136
    px = spark.range(side * side).select(F.lit("i").alias("image_id"), F.lit(0).alias("page"), F.lit(1).cast("long").alias("object"),
                                         F.expr(f"cast(id div {side} as int)").alias("y"), F.expr(f"cast(id % {side} as int)").alias("x"))
    # Two peaks in opposite corners: every other pixel climbs through several tiles.
    d = F.expr(f"least(x + y, {2 * side - 2} - x - y)")
    back = lambda c: (F.lit(objects.SIDE - 1) - F.col(c)).cast("long")
    px = px.withColumn("height", -d.cast("double")).withColumn("rank", (1000 - d).cast("long") * F.lit(objects.SIDE * objects.SIDE) + back("y") * objects.SIDE + back("x"))
    seen = objects._by_tile(px, lambda pdf, own, step: pdf[["y", "x"]][own].assign(n=len(pdf)), "y int, x int, n int")
    assert seen.select("y", "x").distinct().count() == seen.count() == side * side
    assert seen.select("n", F.expr("y div 64"), F.expr("x div 64")).distinct().agg(F.sum("n")).first()[0] < 1.1 * side * side
    got = objects._summits(px, ["image_id", "page", "object"]).groupBy("top").agg(F.count("*").alias("n")).collect()
    peaks = {r["rank"] for r in px.where("(x = 0 and y = 0) or (x = 135 and y = 135)").collect()}
    assert {r["top"] for r in got} == peaks and sum(r["n"] for r in got) == side * side
    cut = objects.watershed(px.select("image_id", "page", "y", "x"), px.select("image_id", "page", "y", "x", "height"), 1.0)
    assert {r["basin"] for r in cut.select("basin").distinct().collect()} == {0, 1, 2}
    assert cut.where("basin = 0 and abs(x + y - 135) > 1").count() == 0


def test_export_spells_numbers_by_decimals_and_provenance_once(spark):
    """Text of an image's provenance is made before the join with its rows; fixed digits need no format."""
    values = [0.0001, -0.0001, 1.0000005, 2.5, -3.1234565, 9999999999.5, 7.0, math.nan, None]
    rows = spark.createDataFrame([(i, "a" if i else "none", v) for i, v in enumerate(values)], "roi_id long, image_id string, mean double")
    prov = spark.createDataFrame([("a", "mm", 0.125)], "image_id string, unit string, threshold_low double")
    out = T.export_rows(rows, prov, ["roi_id", "mean"], decimal=",")
    got = {r["roi_id"]: (r["mean"], r["unit"], r["threshold_low"]) for r in out.collect()}
    assert [got[str(i)][0] for i in range(9)] == ["0,0001", "-0,0001", "1,000001", "2,5", "-3,123457", "9999999999,5", "7", "NaN", ""]
    assert got["0"][1:] == ("", "") and got["1"][1:] == ("mm", "0,125")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "%.6f" not in plan and "isnan(threshold_low" not in plan.split("Join")[0]


def test_grid_is_made_by_many_tasks(spark):
    """Plane headers are a few bytes in one task; the grid that they become is dealt out."""
    planes = spark.range(64).select(F.lit("i").alias("image_id"), F.col("id").cast("int").alias("page"), F.lit(1).alias("channels"), F.lit(4).alias("width"), F.lit(4).alias("height")).coalesce(1)
    shares = [r["count"] for r in views.dense_grid(planes).groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 4 and sum(shares) == 64 * 16


def test_axis_values_are_ranked_once_each(spark, monkeypatch):
    """Only the distinct values of a series are ranked, not an entry for each image and axis."""
    from planeweave.operators import datasets

    ranked, counted = datasets.ranked, []

    def watched(rows, *rest):
        counted.append(rows.count())
        return ranked(rows, *rest)

    monkeypatch.setattr(datasets, "ranked", watched)
    rows = [(f"p{i}", "s", float(i % 3), None if i % 2 else 7.0) for i in range(40)]
    headers = spark.createDataFrame(rows, "path string, series_uid string, t double, echo double").selectExpr(
        "true AS has_pixels", "path AS sop_uid", "path", "series_uid", "'st' AS study_uid", "1 AS series_number", "'f' AS frame_of_reference", "4 AS rows", "4 AS columns",
        "cast(null AS array<double>) AS orientation", "cast(null AS array<double>) AS position", "t", "echo", "1 AS frames", "cast(null AS int) AS instance_number")
    got = sorted(tuple(r)[1:] for r in datasets.series_axis_values(headers).collect())
    assert got == [("t", 0, 0.0), ("t", 1, 1.0), ("t", 2, 2.0)] and counted == [3]

"""Images that arrive in pieces, and again."""

import math
import statistics

import pytest

from planeweave.streaming import incremental as ST

DDL = "image_id string, roi string, value double, version int"


def test_an_image_split_over_batches_is_whole(spark, tmp_path):
    nan = math.nan
    batches = [
        [("a", "r", 1.0, 1), ("a", "r", 2.0, 1), ("b", "r", 5.0, 1), ("c", "r", nan, 1)],
        [("a", "r", 9.0, 1), ("a", "s", 4.0, 1), ("b", "r", 7.0, 2)],
        [("a", "r", nan, 1), ("a", "r", 1e6, 1), ("b", "r", 8.0, 2), ("b", "t", 1.0, 1)],
    ]
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(DDL).parquet(str(inbox))
        ST.collect_partials(stream, ["image_id", "roi"], table, state).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(table).select("batch_id").distinct().count() == 3
    ST.compact(spark, table, str(tmp_path / "compact"), ["image_id", "roi"])
    for path in (table, str(tmp_path / "compact")):
        got = {(r.image_id, r.roi): r for r in ST.merged_results(spark, path, ["image_id", "roi"]).collect()}
        assert set(got) == {("a", "r"), ("a", "s"), ("b", "r"), ("c", "r")}  # b's first version is replaced whole
        r = got["a", "r"]
        assert (r.n, r.non_finite, r.min, r.max) == (4, 1, 1.0, 1e6)
        assert r["mean"] == pytest.approx(250003.0) and r["std"] == pytest.approx(statistics.stdev([1, 2, 9, 1e6]))
        assert (got["b", "r"].n, got["b", "r"]["mean"], got["a", "s"]["std"]) == (2, 7.5, 0.0)
        assert (got["c", "r"].n, got["c", "r"]["mean"], got["c", "r"]["std"]) == (0, None, None)

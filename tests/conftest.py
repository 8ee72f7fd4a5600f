import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from planeweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


def raster(spark, grid, page=0, channel=0):
    rows = [("i", page, channel, y, x, float(v)) for y, line in enumerate(grid) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id string, page int, channel int, y int, x int, value double")


def disc(w, h, discs, inside=200.0, outside=20.0):
    return [[inside if any((x - cx) ** 2 + (y - cy) ** 2 <= r * r for cx, cy, r in discs) else outside for x in range(w)] for y in range(h)]

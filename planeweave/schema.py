"""Column contracts of the long tables."""

from __future__ import annotations

PLANE = ["image_id", "page"]
PIXEL = ["image_id", "page", "y", "x"]
SAMPLE = ["image_id", "page", "channel", "y", "x"]

# Keys of a measurement row: where it was measured, and on what object.
MEASURED_KEYS = [*PLANE, "channel", "roi_id"]

SAMPLES_DDL = "image_id string, page int, channel int, y int, x int, value double"
TILES_DDL = (
    "image_id string, page int, channel int, ty int, tx int, "
    "y0 int, x0 int, h int, w int, data array<float>"
)
PLANES_DDL = (
    "image_id string, page int, channels int, width int, height int, sample_format int, "
    "bits int, type_min double, type_max double, numeric_type string"
)
LABELS_DDL = "image_id string, page int, y int, x int, label bigint"
SPANS_DDL = "roi_id bigint, image_id string, page int, y int, x_start int, x_end int"

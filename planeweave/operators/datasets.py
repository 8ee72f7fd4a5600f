"""Physical files to logical datasets: series, plane maps, filesets, axes, mosaics, meshes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions.numeric import finite
from planeweave.functions.text import base_name, natural_key
from planeweave.schema import PLANE
from planeweave.session import cut_lineage


def ranked(rows: DataFrame, group: list[str], value: list[str], name: str, tie: list[str] | None = None) -> DataFrame:
    """``rows`` with ``name``, the 0-based dense rank of ``value`` within ``group``, by one range shuffle.

    Rows are range-partitioned and sorted on group, value and ``tie`` (which may split equal values),
    numbered as they stream by and written once; a group that goes on in a later partition is shifted
    there by what the earlier ones counted. So no task sees more than its partition, whatever a group's
    size. Two rows of each partition reach the driver. NULL is a value and comes first.
    """
    order = [*group, *value, *(tie or [])]
    names = rows.columns
    extra = "_part int, _rank long, _opening boolean, _edge int"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before, counted, base, groups = None, 0, 0, 0
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new_group = _changes(batch, before, group)
            new_value = new_group | _changes(batch, before, value)
            counts = counted + np.cumsum(new_value)
            # The count at the start of a row's group: the last start so far.
            bases = np.maximum.accumulate(np.where(new_group, counts, base))
            opening = groups + np.cumsum(new_group) == 1
            edge = np.zeros(batch.num_rows, np.int32)
            edge[0] = FIRST if before is None else 0
            if held is not None:
                yield pa.RecordBatch.from_arrays(held, [*names, "_part", "_rank", "_opening", "_edge"])
            held = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(counts - bases), pa.array(opening), pa.array(edge)]
            before, counted, base, groups = batch.slice(batch.num_rows - 1), int(counts[-1]), int(bases[-1]), groups + int(new_group.sum())
        if held is not None:
            edge = held[-1].to_numpy().copy()
            edge[-1] += LAST
            yield pa.RecordBatch.from_arrays([*held[:-1], pa.array(edge)], [*names, "_part", "_rank", "_opening", "_edge"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, {extra}"))
    edges: dict[int, dict[int, tuple]] = {}
    for r in numbered.where("_edge > 0").select("_part", "_edge", "_rank", "_opening", *order).collect():  # two rows a partition
        at = ([_plain(r[c]) for c in group], [_plain(r[c]) for c in value], r["_rank"], r["_opening"])
        for bit in (FIRST, LAST):
            if r["_edge"] & bit:
                edges.setdefault(r["_part"], {})[bit] = at
    shifts, end = [], None
    for part in sorted(edges):
        (g, v, _, _), last = edges[part][FIRST], edges[part][LAST]
        shift = 0 if end is None or end[0] != g else end[2] + (end[1] != v)
        shifts.append((part, shift))
        end = (last[0], last[1], last[2] + (shift if last[3] else 0))
    by_part = rows.sparkSession.createDataFrame(shifts, "_part int, _shift long")  # a row per partition
    shift = F.when(F.col("_opening"), F.coalesce("_shift", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return numbered.join(F.broadcast(by_part), "_part", "left").select(*names, (F.col("_rank") + shift).cast("int").alias(name))


#: Marks of a partition's first and last row.
FIRST, LAST = 1, 2


def _plain(v):
    return "NaN" if isinstance(v, float) and v != v else v


def _changes(batch: pa.RecordBatch, before: pa.RecordBatch | None, columns: list[str]) -> np.ndarray:
    """For each row whether it differs from the row before it in one of the columns; the first of all does."""
    out = np.zeros(batch.num_rows, bool)
    for c in columns:
        now = batch.column(c)
        was = pa.concat_arrays([before.column(c) if before is not None else pa.nulls(1, now.type), now.slice(0, len(now) - 1)])
        differs = pc.fill_null(pc.not_equal(now, was), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(now.type):
            differs &= ~pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(was)), False).to_numpy(zero_copy_only=False)
        out |= differs | (now.is_null().to_numpy(zero_copy_only=False) != was.is_null().to_numpy(zero_copy_only=False))
    if before is None:
        out[0] = True
    return out


def slice_position(position: str = "position", orientation: str = "orientation") -> Column:
    """Distance along the normal of the image plane; NULL without complete geometry."""
    p, o = (lambda i: F.get(position, i)), (lambda i: F.get(orientation, i))
    cross = [o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3)]
    return F.when((F.size(position) >= 3) & (F.size(orientation) >= 6),
                  p(0) * cross[0] + p(1) * cross[1] + p(2) * cross[2])


def _image_headers(headers: DataFrame) -> tuple[DataFrame, Column]:
    """One header row per image, that of the first path in natural order, and the expression of its series."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    angle = F.array_join(F.transform(F.slice("orientation", 1, 6), lambda v: F.format_string("%.4f", v)), "\\")
    identity = F.coalesce(text("series_uid"), F.concat(
        F.coalesce("study_uid", F.lit("")), F.lit("|series-"), F.coalesce(F.col("series_number").cast("string"), F.lit("?"))))
    group_id = F.concat_ws(
        "|", identity, F.coalesce("frame_of_reference", F.lit("")),
        F.concat(F.coalesce("rows", F.lit(0)).cast("string"), F.lit("x"), F.coalesce("columns", F.lit(0)).cast("string")),
        F.coalesce(angle, F.lit("unknown-orientation")))
    needed = ["series_uid", "study_uid", "series_number", "frame_of_reference", "rows", "columns", "orientation", "position", "t", "echo", "frames", "instance_number"]
    h = headers.where("has_pixels").groupBy(F.coalesce(text("sop_uid"), F.col("path")).alias("_key")).agg(
        F.min(F.struct(natural_key("path").alias("_natural"), "path", *needed)).alias("h")).select("_key", "h.*")
    return h, group_id


def _series_images(headers: DataFrame) -> DataFrame:
    """One row per image of the series: ``group_id, path, frames, t, echo, z, t_index, echo_index`` and
    ``_t, _e, _f``, which tell whether its series has a time, echo and frame axis.

    All axes are ranked in one shuffle: an image gives an entry for each axis that its series has.
    """
    h, group_id = _image_headers(headers)
    # Names are spelled out once for each image: several readers follow.
    h = cut_lineage(h.select(
        "_key", "path", group_id.alias("group_id"), F.round(slice_position(), 5).alias("_pos"), F.col("t").cast("double").alias("t"), F.col("echo").cast("double").alias("echo"),
        F.greatest(F.col("frames"), F.lit(1)).cast("int").alias("frames"), F.col("instance_number").cast("long").alias("_number"), natural_key(base_name("path")).alias("_base")))
    several = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    g = h.groupBy("group_id").agg(
        (F.count("_pos") == F.count(F.lit(1))).alias("_all"), several("t").alias("_t"),
        several("echo").alias("_e"), (F.max("frames") > 1).alias("_f"))
    h = h.join(g, "group_id")
    null = F.lit(None)

    def entry(axis: str, dim_t=null, dim_e=null, number=null, place=null, label=null, image=null) -> Column:
        return F.struct(F.lit(axis).alias("axis"), dim_t.cast("double").alias("dim_t"), dim_e.cast("double").alias("dim_e"), number.cast("double").alias("v"),
                        place.cast("long").alias("place"), label.cast("string").alias("label"), image.cast("string").alias("image"))

    # Without positions the order is by instance number, then name; unnumbered images never share a slice.
    place = F.coalesce("_number", F.lit((1 << 53) - 1))
    base, image = F.col("_base"), F.concat_ws("\n", "path", "_key")
    unnumbered = F.col("_number").isNull()
    z = F.when(F.col("_all"), entry("z", number=F.col("_pos"))).when(
        F.col("_t") | F.col("_e"), entry("z", F.when(F.col("_t"), F.col("t")), F.when(F.col("_e"), F.col("echo")), place=place,
                                         label=F.when(unnumbered, base), image=F.when(unnumbered, image))).otherwise(entry("z", place=place, label=base, image=image))
    entries = F.array(z, F.when(F.col("_t") & F.col("t").isNotNull(), entry("t", number=F.col("t"))),
                      F.when(F.col("_e") & F.col("echo").isNotNull(), entry("echo", number=F.col("echo"))))
    keep = ["_key", "path", "group_id", "frames", "t", "echo", "_t", "_e", "_f"]
    e = h.select(*keep, F.explode(entries).alias("a")).where("a is not null").select(*keep, "a.*")
    e = ranked(e, ["group_id", "axis", "dim_t", "dim_e"], ["v", "place", "label", "image"], "rank", ["path", "_key"])
    at = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("rank")))
    return e.groupBy(*keep).agg(at("z").alias("z"), at("t").alias("t_index"), at("echo").alias("echo_index")).drop("_key")


def assemble_series(headers: DataFrame) -> DataFrame:
    """Planes of image series from header rows: ``(group_id, path, frame_index, coordinates)``.

    Copies of an object keep the first path in natural order. Slices rank by position
    rounded to five decimals when every image has one, else by instance number within time
    and echo, else over the whole series. Time and echo axes exist only with several values.
    """
    out = _series_images(headers).withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("int").alias("value"))
    coords = F.filter(F.array(
        entry("z", F.col("z")), F.when(F.col("_t"), entry("t", F.col("t_index"))),
        F.when(F.col("_e"), entry("echo", F.col("echo_index"))), F.when(F.col("_f"), entry("frame", F.col("frame_index")))),
        lambda e: e.isNotNull() & e["value"].isNotNull())
    return out.select("group_id", "path", "frame_index", F.map_from_entries(coords).alias("coordinates"))


def series_axes(headers: DataFrame) -> DataFrame:
    """The axes of each series with their sizes: ``(group_id, position, axis, label, size)``.

    A series of one slice with several frames has no slice axis; time and echo axes exist only with
    several values.
    """
    s = _series_images(headers).groupBy("group_id").agg(
        F.max("z").alias("z"), F.max("frames").alias("frames"), F.max("t_index").alias("t"), F.max("echo_index").alias("echo"), F.first("_f").alias("_f"))
    entry = lambda i, axis, label, size: F.struct(F.lit(i).alias("position"), F.lit(axis).alias("axis"), F.lit(label).alias("label"), size.cast("int").alias("size"))
    axes = F.array_compact(F.array(
        F.when((F.col("z") > 0) | ~F.col("_f"), entry(0, "z", "Slice", F.col("z") + 1)), F.when(F.col("_f"), entry(1, "frame", "Frame", F.col("frames"))),
        F.when(F.col("t").isNotNull(), entry(2, "t", "Time", F.col("t") + 1)), F.when(F.col("echo").isNotNull(), entry(3, "echo", "Echo", F.col("echo") + 1))))
    return s.select("group_id", F.explode(axes).alias("a")).select("group_id", "a.*")


def series_axis_values(headers: DataFrame) -> DataFrame:
    """The value that each index of a time or echo axis stands for: ``(group_id, axis, index, value)``."""
    h, group_id = _image_headers(headers)
    values = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("value")) for c in ("t", "echo")])
    # Slices and names play no part: each value of a series is ranked once, however many images show it.
    v = h.select(group_id.alias("group_id"), F.explode(values).alias("a")).select("group_id", "a.*").where("value IS NOT NULL")
    v = cut_lineage(v.distinct())
    several = v.groupBy("group_id", "axis").count().where("count > 1").select("group_id", "axis")
    return ranked(v.join(several, ["group_id", "axis"], "left_semi"), ["group_id", "axis"], ["value"], "index").select("group_id", "axis", "index", "value")


# --- plane maps --------------------------------------------------------------------------


def plane_axes(order: Column) -> Column:
    """Plane axes of a dimension order, fastest first; absent ones follow as Z, C, T."""
    axes = F.filter(F.split(F.upper(order), ""), lambda a: a.isin("C", "Z", "T"))
    return F.concat(axes, F.array_except(F.array(*[F.lit(a) for a in "ZCT"]), axes))


def _size(axis: Column) -> Column:
    return F.when(axis == "C", F.col("plane_c")).when(axis == "Z", F.col("size_z")).otherwise(F.col("size_t"))


def _strides(df: DataFrame) -> DataFrame:
    """Add ``stride_c/z/t`` of the mixed radix given by the dimension order."""
    df = df.withColumn("_axes", plane_axes(F.col("dimension_order")))
    pos = {a: F.array_position("_axes", a) for a in "CZT"}
    for a in "CZT":
        s = F.lit(1)
        for b in "CZT":
            s = s * F.when(pos[b] < pos[a], _size(F.lit(b))).otherwise(1)
        df = df.withColumn(f"stride_{a.lower()}", s.cast("long"))
    return df.drop("_axes")


def index_coordinates(index: Column) -> dict[str, Column]:
    sizes = {"c": "plane_c", "z": "size_z", "t": "size_t"}
    return {a: F.pmod(F.floor(index / F.col(f"stride_{a}")), F.greatest(F.col(n), F.lit(1))).cast("int") for a, n in sizes.items()}


def plane_channel_size(samples: Column, size_c: Column) -> Column:
    """Channels stored as planes: the number of channel entries when their samples add up
    to the channel count, else that count."""
    total = F.aggregate(samples, F.lit(0), lambda a, v: a + v)
    return F.when((F.size(samples) > 0) & (total == size_c), F.size(samples)).otherwise(size_c)


def channel_of_first(samples: Column, first_c: Column, plane_c: Column) -> Column:
    """Plane channel a first-channel number means: entry index or running sample offset."""
    offsets = F.transform(samples, lambda v, i: F.aggregate(F.slice(samples, 1, i), F.lit(0), lambda a, w: a + F.greatest(w, F.lit(1))))
    hit = F.filter(F.transform(offsets, lambda o, i: F.when((o == first_c) | (i == first_c), i)), lambda i: i.isNotNull())
    limit = F.greatest(F.size(samples), plane_c) - 1
    return F.coalesce(F.get(hit, 0), F.greatest(F.lit(0), F.least(limit, first_c)))


def plane_map(images: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every plane a range list declares, with coordinates and page; later ranges win.

    ``images``: ``image_id, dimension_order, size_c, size_z, size_t, samples, uuid``;
    ``ranges``: ``image_id, ordinal, ifd, first_c, first_z, first_t, plane_count, file_name,
    uuid``. Without a page the range covers all planes, with one it covers a single plane.
    """
    im = images.withColumn("plane_c", plane_channel_size(F.col("samples"), F.col("size_c")))
    r = ranges.withColumnRenamed("uuid", "ref_uuid").join(_strides(im), "image_id")
    expected = F.col("plane_c") * F.col("size_z") * F.col("size_t")
    first_c = channel_of_first(F.col("samples"), F.coalesce("first_c", F.lit(0)), F.col("plane_c"))
    start = (first_c * F.col("stride_c") + F.coalesce("first_z", F.lit(0)) * F.col("stride_z")
             + F.coalesce("first_t", F.lit(0)) * F.col("stride_t"))
    count = F.when(F.col("plane_count") > 0, F.col("plane_count")).otherwise(F.when(F.col("ifd").isNull(), expected).otherwise(1))
    r = r.withColumn("_k", F.explode(F.sequence(F.lit(0), count.cast("int") - 1))).withColumn("_i", start + F.col("_k"))
    c = index_coordinates(F.col("_i"))
    local = F.coalesce(F.col("file_name") == "", F.lit(True)) | F.coalesce((F.col("uuid") != "") & (F.col("uuid") == F.col("ref_uuid")), F.lit(False))
    r = r.select("image_id", *[v.alias(a) for a, v in c.items()], (F.coalesce("ifd", F.lit(0)) + F.col("_k")).alias("page"),
                 "file_name", local.alias("local"), F.struct("ordinal", "_k").alias("_last"))
    return r.groupBy("image_id", "c", "z", "t").agg(
        F.max_by(F.struct("page", "file_name", "local"), "_last").alias("p")).select("image_id", "c", "z", "t", "p.*")


def default_plane_index(images: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Linear plane number of coordinates where no range maps them."""
    return coordinates.join(_strides(images), "image_id").select(
        "image_id", "c", "z", "t", (F.col("c") * F.col("stride_c") + F.col("z") * F.col("stride_z") + F.col("t") * F.col("stride_t")).alias("page"))


def resolve_fileset(planes: DataFrame, files: DataFrame) -> DataFrame:
    """Planes whose referenced file exists, matched by base name; an absent reference means
    the describing file itself. Series left without planes vanish."""
    name = F.regexp_extract(F.regexp_replace(F.coalesce(F.when(F.col("file_name") != "", F.col("file_name")), F.col("self_name"), F.lit("")), r"\\", "/"), r"([^/]*)$", 1)
    return planes.withColumn("base", name).join(
        files.select(base_name("path").alias("base"), F.col("path").alias("resource")), "base")


# --- loops, lookups, extents --------------------------------------------------------------

# Axis names of acquisition loop types.
LOOP_AXES = {1: "T", 8: "T", 9: "T", 2: "P", 3: "P", 4: "Z", 10: "Z", 6: "L"}


def loop_axes(acquisitions: DataFrame) -> DataFrame:
    """``axes array<struct<name, size, stride>>`` from loops listed outermost first.

    An exact integer factor the loops do not explain becomes one innermost axis (P, or S
    when P is taken); loops that do not divide the frame count give a flat Frame axis.
    """
    names = F.create_map(*[F.lit(v) for kv in LOOP_AXES.items() for v in kv])
    d = acquisitions.withColumn("_l", F.transform(F.filter("loops", lambda e: e["count"] > 1), lambda e: F.struct(
        F.coalesce(F.try_element_at(names, e["type"]), F.lit("Other")).alias("name"), e["count"].cast("int").alias("size"))))
    d = d.withColumn("_p", F.aggregate("_l", F.lit(1).cast("long"), lambda a, e: a * e["size"]))
    rest = F.floor(F.col("frames") / F.col("_p")).cast("int")
    extra = F.when(rest > 1, F.array(F.struct(F.when(F.exists("_l", lambda e: e["name"] == "P"), F.lit("S")).otherwise("P").alias("name"), rest.alias("size"))))
    none = F.expr("cast(array() as array<struct<name string, size int>>)")
    flat = F.array(F.struct(F.lit("Frame").alias("name"), F.col("frames").cast("int").alias("size")))
    axes = F.when(F.col("frames") <= 0, none).when(F.col("frames") % F.col("_p") == 0, F.concat("_l", F.coalesce(extra, none))).otherwise(flat)
    d = d.withColumn("_a", axes)
    stride = lambda i: F.aggregate(F.slice("_a", i + 2, F.size("_a")), F.lit(1).cast("long"), lambda a, e: a * e["size"])
    return d.withColumn("axes", F.transform("_a", lambda e, i: F.struct(
        e["name"].alias("name"), e["size"].alias("size"), stride(i).alias("stride")))).drop("_l", "_p", "_a")


def loop_frames(acquisitions: DataFrame) -> DataFrame:
    """One row per frame with its coordinates (last axis fastest)."""
    d = loop_axes(acquisitions).where("frames > 0").withColumn("frame", F.explode(F.expr("sequence(0, frames - 1)")))
    pos = F.transform("axes", lambda a: F.struct(a["name"], F.pmod(F.floor(F.col("frame") / a["stride"]), a["size"]).cast("int")))
    return d.select("image_id", "frame", F.map_from_entries(pos).alias("coordinates"))


def lookup_planes(requests: DataFrame, axes: DataFrame, planes: DataFrame) -> DataFrame:
    """Plane of each request after clamping its coordinates to the series' axes.

    ``axes``: ``series_id, axis, size``. Both sides are reduced to one coordinate list in
    axis order, which makes the lookup an equi-join.
    """
    a = axes.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("axis", "size"))).alias("_axes"))
    at = lambda e: F.coalesce(F.try_element_at("coordinates", e["axis"]), F.lit(0))
    want = F.transform("_axes", lambda e: F.greatest(F.lit(0), F.least(e["size"] - 1, at(e).cast("int"))))
    have = F.transform("_axes", lambda e: at(e).cast("int"))
    # A series without axes has one position, the empty list.
    empty = F.expr("cast(array() as array<struct<axis string, size int>>)")
    with_axes = lambda df: df.join(a, "series_id", "left").withColumn("_axes", F.coalesce("_axes", empty))
    p = with_axes(planes).select("series_id", have.alias("_at"), "resource", "plane_order")
    p = p.groupBy("series_id", "_at").agg(F.min_by("resource", "plane_order").alias("resource"))
    return with_axes(requests).select("request_id", "series_id", want.alias("_at")).join(
        p, ["series_id", "_at"]).select("request_id", "series_id", F.col("_at").alias("position"), "resource")


def axis_extents(tiles: DataFrame) -> DataFrame:
    """Inclusive range of every non-spatial axis over ``dims map<string, struct<start, size>>``;
    the mosaic axis M selects nothing and is left out."""
    d = tiles.select("image_id", F.explode("dims").alias("axis", "d")).where(~F.col("axis").isin("X", "Y", "M"))
    return d.groupBy("image_id", "axis").agg(
        F.min("d.start").alias("min"), F.max(F.col("d.start") + F.greatest("d.size", F.lit(1)) - 1).alias("max"))


def assemble_mosaic(tiles: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plane headers and samples of a mosaic shifted to its origin; the last tile in
    directory order wins and uncovered pixels are 0.

    ``tiles``: ``image_id, page, tile_order, x0, y0, w, h``; ``pixels``: ``image_id, page,
    tile_order, channel, y, x, value`` in tile coordinates. The winner is an aggregate, so
    overlaps combine before the shuffle.
    """
    ext = tiles.groupBy(*PLANE).agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"),
                                    F.max(F.col("x0") + F.col("w")).alias("_x1"), F.max(F.col("y0") + F.col("h")).alias("_y1"))
    j = pixels.join(tiles.select(*PLANE, "tile_order", "x0", "y0"), [*PLANE, "tile_order"]).join(ext, PLANE)
    win = j.groupBy(*PLANE, "channel", (F.col("y0") - F.col("_y") + F.col("y")).alias("y"), (F.col("x0") - F.col("_x") + F.col("x")).alias("x")).agg(
        F.max_by("value", "tile_order").alias("value"))
    channels = pixels.groupBy(*PLANE).agg((F.max("channel") + 1).alias("channels"))
    planes = ext.join(channels, PLANE).select(*PLANE, "channels", (F.col("_x1") - F.col("_x")).alias("width"), (F.col("_y1") - F.col("_y")).alias("height"))
    from planeweave.sources.views import dense_grid
    full = dense_grid(planes).join(win, [*PLANE, "channel", "y", "x"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return planes, full


MESH_WIDTH, MESH_HEIGHT = 720, 360


def rasterize_mesh(cells: DataFrame, vertices: DataFrame) -> DataFrame:
    """Cells of an unstructured mesh on a 720 x 360 longitude/latitude grid; covered pixels
    only, the later cell wins.

    ``cells``: ``mesh_id, cell, corner_ids array<bigint>, value``; ``vertices``: ``mesh_id,
    vertex, lon, lat`` in degrees or radians (latitudes beyond pi mean degrees). Corners are
    unwrapped around the first one and the polygon is drawn at three horizontal shifts.
    """
    unit = vertices.groupBy("mesh_id").agg(F.max(F.abs(F.when(finite("lat"), F.col("lat")))).alias("_m"))
    k = F.when(F.col("_m") > math.pi, F.lit(math.pi / 180)).otherwise(1.0)
    v = vertices.join(unit, "mesh_id").select(
        "mesh_id", "vertex", ((F.col("lon") * k + math.pi) / (2 * math.pi) * MESH_WIDTH).alias("vx"),
        ((math.pi / 2 - F.col("lat") * k) / math.pi * MESH_HEIGHT).alias("vy"))
    c = cells.where(finite("value")).select("mesh_id", "cell", "value", F.posexplode("corner_ids").alias("i", "vertex")).join(v, ["mesh_id", "vertex"])
    p = c.groupBy("mesh_id", "cell", "value").agg(F.sort_array(F.collect_list(F.struct("i", "vx", "vy"))).alias("p")).where("size(p) >= 3")
    half = MESH_WIDTH / 2
    p = p.withColumn("p", F.expr(f"""transform(p, e -> struct(
        e.vx - {MESH_WIDTH} * case when e.vx - p[0].vx > {half} then ceil((e.vx - p[0].vx - {half}) / {MESH_WIDTH})
                                   when e.vx - p[0].vx < -{half} then -ceil((p[0].vx - e.vx - {half}) / {MESH_WIDTH}) else 0 end as x, e.vy as y))"""))
    e = p.select("mesh_id", "cell", "value", F.explode(F.expr(
        "transform(p, (b, i) -> struct(p[(i + size(p) - 1) % size(p)].x as ax, p[(i + size(p) - 1) % size(p)].y as ay, b.x as bx, b.y as by))")).alias("e")).select(
        "mesh_id", "cell", "value", "e.*").where("ay <> by")
    e = e.withColumn("y0", F.expr("greatest(cast(ceil(least(ay, by) - 0.5D) as int), 0)")).withColumn(
        "y1", F.expr(f"least(cast(ceil(greatest(ay, by) - 0.5D) as int) - 1, {MESH_HEIGHT - 1})")).where("y1 >= y0")
    e = e.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("c", F.expr("ax + (y + 0.5D - ay) * (bx - ax) / (by - ay)"))
    lines = e.groupBy("mesh_id", "cell", "value", "y").agg(F.sort_array(F.collect_list("c")).alias("c"))
    s = lines.select("mesh_id", "cell", "value", "y", F.explode(F.expr(
        "transform(sequence(0, size(c) div 2 - 1), k -> struct(c[2 * k] as a, c[2 * k + 1] as b))")).alias("s"),
        F.array(*[F.lit(float(d)) for d in (-MESH_WIDTH, 0, MESH_WIDTH)]).alias("shifts"))
    s = s.select("mesh_id", "cell", "value", "y", "s.a", "s.b", F.explode("shifts").alias("d"))
    s = s.withColumn("x0", F.greatest(F.ceil(F.col("a") + F.col("d")), F.lit(0).cast("long"))).withColumn(
        "x1", F.least(F.floor(F.col("b") + F.col("d")), F.lit(MESH_WIDTH - 1).cast("long"))).where("x1 >= x0")
    s = s.withColumn("x", F.explode(F.sequence("x0", "x1")))
    return s.groupBy("mesh_id", "y", F.col("x").cast("int").alias("x")).agg(F.max_by("value", "cell").alias("value"))

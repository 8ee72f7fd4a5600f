"""Raster files read by byte ranges: headers first, then strips of samples, so that no task holds a file.

1. A header task per file reads its head (and the directory of an NPZ) and describes every plane in it: where
   its samples lie, how they are stored, and what their values mean. All channels of an NPY array, all
   slices and image units of a FITS file and all members of an NPZ are planes or channels of their own.
2. Planes become strips of one tile's height and a bounded number of columns, dealt to tasks on their own.
3. A strip task reads its byte ranges and emits tiles. A compressed NPZ member can only be read from its
   start; its strips go to one task, which streams it and holds one strip.

Files are opened through ``pyarrow.fs``, which reaches local and network file systems by URI. Text variants
of Netpbm have no fixed sample positions and are decoded by :mod:`raster_files`. What cannot be read becomes
a row with ``error``; files without a byte are not listed by Spark.
"""

from __future__ import annotations

import math
import re
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions.text import route_formats
from planeweave.sources import raster_files as whole

HEAD = 1 << 16
STRIP_BYTES = 8 << 20
#: How a plane's samples lie in its file: lines of interleaved samples, columns of one channel (Fortran
#: order), or lines of bits.
LINES, COLUMNS, BITS = "lines", "columns", "bits"
_PLAN_DDL = ("path string, image_id string, page int, member string, layout string, dtype string, start long, scale double, zero double, "
             "blank double, flip boolean, channels int, width int, height int, sample_format int, bits int, type_min double, "
             "type_max double, numeric_type string, error string")
_PLAN = [c.split()[0] for c in _PLAN_DDL.split(", ")]


def _open(path: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    store, at = fs.FileSystem.from_uri(uri if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", uri) else f"file://{uri}")
    return store.open_input_file(at)


def _plane(path, dtype, start, h, w, c, facts, **more) -> dict:
    names = ("sample_format", "bits", "type_min", "type_max", "numeric_type")
    return {**dict.fromkeys(_PLAN), "path": path, "image_id": path, "page": 0, "layout": LINES, "dtype": dtype, "start": start, "scale": 1.0, "zero": 0.0,
            "flip": False, "channels": c, "width": w, "height": h, **dict(zip(names, facts)), **more}


def _npy_head(path: str, f, start: int = 0, **more) -> dict:
    """The plane of an NPY array whose head ``f`` stands at; ``start`` is that place in the file."""
    before = f.tell()
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"unsupported NPY version {version}")
    shape, fortran, dtype = read(f)
    if len(shape) not in (2, 3) or dtype.hasobject:
        raise ValueError(f"unsupported array of shape {shape} and type {dtype}")
    h, w, c = (*shape, 1)[:3]
    return _plane(path, dtype.str, start + f.tell() - before, h, w, c, whole._facts(dtype), layout=COLUMNS if fortran else LINES, **more)


def _npy(path: str, f) -> list[dict]:
    return [_npy_head(path, f)]


def _npz(path: str, f) -> list[dict]:
    out = []
    with zipfile.ZipFile(f) as z:
        for m in z.infolist():
            if not m.filename.endswith(".npy"):
                continue
            name = f"{path}#{m.filename}"
            try:
                if m.compress_type == zipfile.ZIP_STORED:
                    f.seek(m.header_offset + 26)
                    sizes = np.frombuffer(f.read(4), "<u2")
                    start = m.header_offset + 30 + int(sizes.sum())
                    f.seek(start)
                    out.append(_npy_head(path, f, start, image_id=name))
                else:
                    with z.open(m) as inner:
                        out.append(_npy_head(path, inner, image_id=name, member=m.filename))
            except Exception as exc:  # a bad member does not hide the others
                out.append({**dict.fromkeys(_PLAN), "path": path, "image_id": name, "error": f"{type(exc).__name__}: {exc}"})
    if not out:
        raise ValueError("no arrays")
    return out


def _pfm(path: str, f) -> list[dict]:
    m = re.match(rb"\s*(PF|Pf)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)[^\n\r]*[\r\n]+(?:#[^\n]*\n)*\s*([-+0-9.eE]+)[^\n\r]*[\r\n]", f.read(HEAD))
    if not m:
        raise ValueError("invalid PFM header")
    return [_plane(path, "<f4" if float(m[4]) < 0 else ">f4", m.end(), int(m[3]), int(m[2]), 3 if m[1] == b"PF" else 1, (3, 32, 0.0, 1.0, "float32"), flip=True)]


def _netpbm(path: str, f) -> list[dict]:
    head = f.read(HEAD)
    magic = head[:2]
    if magic not in (b"P4", b"P5", b"P6"):
        raise ValueError("text")
    m = re.match(rb"P\d" + rb"(?:\s+|#[^\n]*\n)+(\d+)" * (2 if magic == b"P4" else 3), head)
    if not m:
        raise ValueError("invalid Netpbm header")
    w, h, top = int(m[1]), int(m[2]), 1 if magic == b"P4" else int(m[3])
    if not (w and h and top):
        raise ValueError("invalid dimensions or maximum")
    if magic == b"P4":  # 1 is black
        return [_plane(path, "|u1", m.end() + 1, h, w, 1, (1, 8, 0.0, 255.0, "uint8"), layout=BITS)]
    bits = 16 if top > 255 else 8
    return [_plane(path, ">u2" if bits == 16 else "|u1", m.end() + 1, h, w, 3 if magic == b"P6" else 1, (1, bits, 0.0, float(top), f"uint{bits}"))]


_FITS = {8: "|u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def _fits(path: str, f) -> list[dict]:
    """Every slice of every image unit, in file order; pages count on over units."""
    out, at, size = [], 0, f.size()
    while at + 80 <= size:
        head, card, first = {}, at, at == 0
        f.seek(at)
        while True:
            text = f.read(80).decode("latin1")
            if len(text) < 80:
                raise ValueError("missing END card")
            card += 80
            if text[:8].strip() == "END":
                break
            if text[8:10] == "= ":
                head[text[:8].strip()] = text[10:].split("/")[0].strip().strip("'").strip()
        start = -(-card // 2880) * 2880
        axes = [int(float(head.get(f"NAXIS{i}", 0))) for i in range(1, int(head.get("NAXIS", 0)) + 1)]
        bitpix = int(head.get("BITPIX", 0))
        if (first or head.get("XTENSION", "").upper() == "IMAGE") and len(axes) >= 2 and min(axes) > 0 and bitpix in _FITS:
            scale, zero, bits = float(head.get("BSCALE", 1)), float(head.get("BZERO", 0)), abs(bitpix)
            kind = 3 if bitpix < 0 else 1 if bitpix == 8 else 2
            lo, hi = {3: (0.0, 1.0), 1: (0.0, 255.0)}.get(kind, (-2.0 ** (bits - 1), 2.0 ** (bits - 1) - 1))
            name = f"float{bits}" if kind == 3 else "uint8" if kind == 1 else "int16" if bits <= 16 else "int32"
            facts = (kind, bits, *sorted((zero + scale * lo, zero + scale * hi)), name)
            slice_bytes = axes[0] * axes[1] * bits // 8
            for k in range(math.prod(axes[2:])):
                out.append(_plane(path, _FITS[bitpix], start + k * slice_bytes, axes[1], axes[0], 1, facts, page=len(out), flip=True, scale=scale, zero=zero,
                                  blank=float(head["BLANK"]) if "BLANK" in head else None))
        data = math.prod(axes) * abs(bitpix) // 8 if axes else 0
        at = start + -(-data // 2880) * 2880
    if not out:
        raise ValueError("no image unit")
    return out


_HEADS = {"npy": _npy, "npz": _npz, "pfm": _pfm, "netpbm": _netpbm, "fits": _fits}


def _line_bytes(p) -> int:
    return (p["width"] + 7) // 8 if p["layout"] == BITS else p["width"] * p["channels"] * np.dtype(p["dtype"]).itemsize


def plan_planes(files: DataFrame) -> DataFrame:
    """One row per plane of each ``(path[, hint])`` file, or one with ``error``; reads heads only."""
    f = files if "hint" in files.columns else files.withColumn("hint", F.lit(None).cast("string"))
    f = route_formats(f).select("path", F.when(F.lower("path").endswith(".npz"), "npz").otherwise(F.col("kind")).alias("kind"))

    def run(batches):
        for pdf in batches:
            for path, kind in zip(pdf.path, pdf.kind):
                try:
                    if kind not in _HEADS:
                        raise ValueError(f"no reader for {kind}")
                    with _open(path) as file:
                        rows = _HEADS[kind](path, file)
                        size = file.size()
                    for r in rows:
                        if r["error"] is None and (r["width"] < 1 or r["height"] < 1 or r["channels"] < 1):
                            r["error"] = "ValueError: no samples"
                        elif r["error"] is None and r["member"] is None and r["start"] + _line_bytes(r) * r["height"] > size:
                            r["error"] = "ValueError: insufficient data"
                except Exception as exc:  # any malformed file belongs in quarantine
                    rows = [{**dict.fromkeys(_PLAN), "path": path, "image_id": path, "error": f"{type(exc).__name__}: {exc}"}]
                yield pd.DataFrame(rows, columns=_PLAN)

    return f.mapInPandas(run, _PLAN_DDL)


def strips(planes: DataFrame, tile: int = 256, tasks: int | None = None) -> DataFrame:
    """One row per strip ``(y0, x0, lines, columns)`` of the planes; a compressed member's plane is one strip
    as far as tasks go, and is cut while it is streamed."""
    item = F.regexp_extract("dtype", r"(\d+)$", 1).cast("long")
    wide = F.greatest(F.floor(F.lit(STRIP_BYTES) / (item * F.col("channels") * tile * tile)), F.lit(1)).cast("int") * tile
    streamed = F.col("member").isNotNull()
    s = planes.where("error is null").withColumn("_wide", F.when(streamed, F.col("width")).otherwise(wide))
    s = s.withColumn("y0", F.explode(F.when(streamed, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("height") - 1, F.lit(tile)))))
    s = s.withColumn("x0", F.explode(F.when(streamed, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("width") - 1, F.col("_wide")))))
    s = s.withColumns({"lines": F.when(streamed, F.col("height")).otherwise(F.least(F.lit(tile), F.col("height") - F.col("y0"))),
                       "columns": F.least(F.col("_wide"), F.col("width") - F.col("x0"))}).drop("_wide")
    return s.repartition(tasks or int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "page", "member", "y0", "x0")


def _samples(f, p) -> np.ndarray:
    """The strip as (lines, columns, channels), stored values."""
    dtype, w, c, h = np.dtype(p.dtype), p.width, p.channels, p.height
    y = h - p.y0 - p.lines if p.flip else p.y0

    def read(at: int, n: int, kind=dtype) -> np.ndarray:
        f.seek(int(p.start + at))
        raw = f.read(int(n))
        if len(raw) < n:
            raise ValueError("insufficient data")
        return np.frombuffer(raw, kind)

    if p.layout == BITS:
        wide = (w + 7) // 8
        bits = np.unpackbits(read(y * wide, p.lines * wide, np.uint8).reshape(p.lines, wide), axis=1)[:, p.x0:p.x0 + p.columns]
        return ((1 - bits) * 255)[..., None]
    if p.layout == COLUMNS:
        n = dtype.itemsize
        out = np.empty((p.lines, p.columns, c), dtype)
        for k in range(c):
            for x in range(p.columns):  # a column's lines lie together
                out[:, x, k] = read(((k * w + p.x0 + x) * h + y) * n, p.lines * n)
        return out
    n = c * dtype.itemsize
    if p.columns == w:
        out = read(y * w * n, p.lines * w * n).reshape(p.lines, w, c)
    else:
        out = np.stack([read(((y + k) * w + p.x0) * n, p.columns * n).reshape(p.columns, c) for k in range(p.lines)])
    return out[::-1] if p.flip else out


def _values(p, stored: np.ndarray) -> np.ndarray:
    if p.scale == 1 and p.zero == 0 and pd.isna(p.blank):
        return stored.astype(np.float32)
    value = p.zero + p.scale * stored.astype(float)
    if not pd.isna(p.blank):
        value[stored == p.blank] = np.nan
    return value.astype(np.float32)


_TILE = ["image_id", "page", "channel", "ty", "tx", "y0", "x0", "h", "w", "data"]
_FACTS = ["channels", "width", "height", "sample_format", "bits", "type_min", "type_max", "numeric_type"]


def _tiles(p, values: np.ndarray, y0: int, x0: int, tile: int) -> pd.DataFrame:
    facts = [getattr(p, k) for k in _FACTS]
    h = values.shape[0]
    rows = [(p.image_id, p.page, c, y0 // tile, (x0 + x) // tile, y0, x0 + x, h, min(tile, values.shape[1] - x), np.ascontiguousarray(values[:, x:x + tile, c]).ravel(), *facts, None)
            for c in range(values.shape[2]) for x in range(0, values.shape[1], tile)]
    return pd.DataFrame(rows, columns=[*_TILE, *_FACTS, "error"])


def _streamed(p, tile: int):
    """Tiles of a compressed member, one strip at a time. Columns (Fortran order) come as strips of a tile's
    width over one channel."""
    dtype, c = np.dtype(p.dtype), p.channels
    with _open(p.path) as file, zipfile.ZipFile(file) as z, z.open(p.member) as f:
        f.read(int(p.start))

        def read(n: int) -> np.ndarray:
            raw = f.read(n * dtype.itemsize)
            if len(raw) < n * dtype.itemsize:
                raise ValueError("insufficient data")
            return np.frombuffer(raw, dtype)

        if p.layout == LINES:
            for y in range(0, p.height, tile):
                n = min(tile, p.height - y)
                yield _tiles(p, _values(p, read(n * p.width * c).reshape(n, p.width, c)), y, 0, tile)
            return
        for k in range(c):
            for x in range(0, p.width, tile):
                n = min(tile, p.width - x)
                block = _values(p, read(n * p.height).reshape(n, p.height).T[..., None])
                for y in range(0, p.height, tile):
                    yield _tiles(p, block[y:y + tile], y, x, tile).assign(channel=k)


def read_strips(found: DataFrame, tile: int = 256) -> DataFrame:
    """Tiles of the strips, or a row with ``error`` for a strip that cannot be read."""
    def run(batches):
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                try:
                    if p.member is not None:
                        yield from _streamed(p, tile)
                        continue
                    with _open(p.path) as f:
                        values = _values(p, _samples(f, p))
                    yield _tiles(p, values, p.y0, p.x0, tile)
                except Exception as exc:  # any malformed file belongs in quarantine
                    yield pd.DataFrame([(p.image_id, *[None] * (len(_TILE) + len(_FACTS) - 1), f"{type(exc).__name__}: {exc}")], columns=[*_TILE, *_FACTS, "error"])

    return found.mapInPandas(run, whole._DDL)


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length)`` of the files below a folder; their content is not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "length")


def ingest(spark: SparkSession, path: str, glob: str | None = None, tile: int = 256, tasks: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles, plane headers and quarantine rows of all files below a folder.

    Text Netpbm files, of which only whole contents can be parsed, are read as :func:`raster_files.decode`
    reads them; their rows join the others.
    """
    files = list_files(spark, path, glob).drop("length")
    planned = plan_planes(files)
    text = planned.where("error = 'ValueError: text'").select("path")
    old = whole.decode(whole.read_files(spark, path, glob).join(text, "path", "left_semi"), tile)
    tiles = read_strips(strips(planned, tile, tasks), tile).unionByName(old)
    bad = planned.where("error is not null and error <> 'ValueError: text'").select(F.col("image_id").alias("path"), "error")
    ok = tiles.where("error is null")
    heads = planned.where("error is null").select("image_id", "page", *_FACTS).unionByName(
        old.where("error is null and channel = 0 and ty = 0 and tx = 0").select("image_id", "page", *_FACTS))
    bad = bad.unionByName(tiles.where("error is not null").select(F.col("image_id").alias("path"), "error")).distinct()
    return ok.select(*_TILE), heads, bad


def write_bands(samples: DataFrame, folder: str, kind: str = "npy", lines: int = 64) -> DataFrame:
    """Write the samples as files ``<image>_<page>_<first line>.<kind>`` of at most ``lines`` lines, in a folder
    that all executors share, and return ``(path, count)`` rows; the files are there once these are collected.

    ``npy`` and ``npz`` (one array a channel, compressed) hold channels, ``fits`` a slice for each. A task
    holds one band; missing samples are NaN. Files are written anew when a task is run again.
    """
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        from pyarrow import fs

        y0 = int(pdf.band.iloc[0]) * lines
        a = np.full((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) + 1, int(pdf.channel.max()) + 1), np.nan, np.float32)
        a[pdf.y - y0, pdf.x, pdf.channel] = pdf.value
        out = io.BytesIO()
        if kind == "npy":
            np.save(out, a)
        elif kind == "npz":
            np.savez_compressed(out, **{f"channel{c}": a[..., c] for c in range(a.shape[2])})
        else:
            cards = [("SIMPLE", "T"), ("BITPIX", -32), ("NAXIS", 3), ("NAXIS1", a.shape[1]), ("NAXIS2", a.shape[0]), ("NAXIS3", a.shape[2])]
            head = b"".join(f"{k:<8}= {v:>20}".ljust(80).encode() for k, v in cards) + b"END".ljust(80)
            data = np.ascontiguousarray(a[::-1].transpose(2, 0, 1)).astype(">f4").tobytes()
            out.write(head.ljust(-(-len(head) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0"))
        store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")
        name = f"{at}/{pdf.image_id.iloc[0]}_{pdf.page.iloc[0]}_{y0}.{kind}"
        with store.open_output_stream(name) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"path": [name], "count": [len(pdf)]})

    banded = samples.withColumn("band", F.expr(f"y div {lines}"))
    return banded.groupBy("image_id", "page", "band").applyInPandas(write, "path string, count long")


def make_folder(folder: str) -> str:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")
    store.create_dir(at, recursive=True)
    return folder

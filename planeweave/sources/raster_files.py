"""Bulk ingest of simple uncompressed raster files: NPY, PFM, Netpbm, FITS.

Files come from ``binaryFile`` (or any ``path, content`` rows), one file per row; each is
decoded with numpy inside its task into fixed-size tiles. A file that cannot be decoded
becomes a quarantine row and does not fail the job.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.functions.text import route_formats

READABLE = ("npy", "pfm", "netpbm", "fits")
_DDL = ("image_id string, page int, channel int, ty int, tx int, y0 int, x0 int, h int, w int, data array<float>, "
        "channels int, width int, height int, sample_format int, bits int, type_min double, type_max double, "
        "numeric_type string, error string")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "content")


def _facts(dtype: np.dtype) -> tuple:
    kind = {"u": 1, "i": 2, "f": 3, "b": 1}[dtype.kind]
    if kind == 3:
        return kind, dtype.itemsize * 8, 0.0, 1.0, f"float{dtype.itemsize * 8}"
    info = np.iinfo(np.uint8 if dtype.kind == "b" else dtype)
    return kind, info.bits, float(info.min), float(info.max), f"{'u' if kind == 1 else ''}int{info.bits}"


def _npy(raw: bytes):
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if a.ndim not in (2, 3):
        raise ValueError(f"unsupported number of dimensions {a.ndim}")
    a = a[..., None] if a.ndim == 2 else a
    return a, _facts(a.dtype), a.shape[2]


def _pfm(raw: bytes):
    m = re.match(rb"\s*(PF|Pf)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)[^\n\r]*[\r\n]+(?:#[^\n]*\n)*\s*([-+0-9.eE]+)[^\n\r]*[\r\n]", raw)
    if not m:
        raise ValueError("invalid PFM header")
    c, w, h = (3 if m[1] == b"PF" else 1), int(m[2]), int(m[3])
    order = "<f4" if float(m[4]) < 0 else ">f4"
    a = np.frombuffer(raw, order, w * h * c, m.end()).reshape(h, w, c)
    return a[::-1], (3, 32, 0.0, 1.0, "float32"), c


def _netpbm(raw: bytes):
    magic = raw[:2]
    if magic not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("invalid Netpbm magic")
    bitmap, text, c = magic in (b"P1", b"P4"), magic in (b"P1", b"P2", b"P3"), 3 if magic in (b"P3", b"P6") else 1
    fields = rb"P\d" + rb"(?:\s+|#[^\n]*\n)+(\d+)" * (2 if bitmap else 3)
    m = re.match(fields, raw)
    if not m:
        raise ValueError("invalid Netpbm header")
    w, h, top = int(m[1]), int(m[2]), 1 if bitmap else int(m[3])
    if not (w and h and top):
        raise ValueError("invalid dimensions or maximum")
    n = w * h * c
    if text:
        body = re.sub(rb"#[^\n]*", b"", raw[m.end():])
        values = np.array(body.split()[:n], dtype=np.int64)
    elif bitmap:
        rows = np.frombuffer(raw, np.uint8, (w + 7) // 8 * h, m.end() + 1).reshape(h, -1)
        values = np.unpackbits(rows, axis=1)[:, :w].ravel().astype(np.int64)
    else:
        values = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, n, m.end() + 1).astype(np.int64)
    if values.size < n:
        raise ValueError("insufficient data")
    if text and ((values < 0) | (values > top)).any():
        raise ValueError("sample outside 0..maximum")
    if bitmap:  # 1 is black
        values, top = (1 - values) * 255, 255
    bits = 16 if top > 255 else 8
    return values.reshape(h, w, c), (1, bits, 0.0, float(top), f"uint{bits}"), c


def _fits(raw: bytes):
    at = 0
    while at + 80 <= len(raw):
        head, card = {}, at
        while True:
            text = raw[card:card + 80].decode("latin1")
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
        kinds = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
        if (at == 0 or head.get("XTENSION", "").upper() == "IMAGE") and len(axes) >= 2 and axes[0] > 0 and axes[1] > 0 and bitpix in kinds:
            w, h = axes[0], axes[1]
            stored = np.frombuffer(raw, kinds[bitpix], w * h, start).reshape(h, w).astype(float)
            scale, zero = float(head.get("BSCALE", 1) or 1), float(head.get("BZERO", 0) or 0)
            value = zero + scale * stored
            if "BLANK" in head:
                value[stored == float(head["BLANK"])] = np.nan
            bits = abs(bitpix)
            lo, hi = {3: (0.0, 1.0), 1: (0.0, 255.0)}.get(3 if bitpix < 0 else 1 if bitpix == 8 else 2, (-2.0 ** (bits - 1), 2.0 ** (bits - 1) - 1))
            ends = sorted((zero + scale * lo, zero + scale * hi))
            name = f"float{bits}" if bitpix < 0 else "uint8" if bitpix == 8 else "int16" if bits <= 16 else "int32"
            return value[::-1, :, None], (3 if bitpix < 0 else 1 if bitpix == 8 else 2, bits, *ends, name), 1
        size = int(np.prod(axes)) * bits_of(bitpix) if axes else 0
        at = start + -(-size // 2880) * 2880
    raise ValueError("no image unit")


def bits_of(bitpix: int) -> int:
    return abs(bitpix) // 8


_DECODERS = {"npy": _npy, "pfm": _pfm, "netpbm": _netpbm, "fits": _fits}


def decode(files: DataFrame, tile: int = 256) -> DataFrame:
    """Tiles, or one row with ``error`` per bad file, from ``(path, content[, hint])`` rows."""
    f = files if "hint" in files.columns else files.withColumn("hint", F.lit(None).cast("string"))
    f = route_formats(f).select("path", "content", "kind")

    def run(batches):
        for pdf in batches:
            for path, content, kind in zip(pdf.path, pdf.content, pdf.kind):
                yield _tile_rows(path, content, kind, tile)

    return f.mapInPandas(run, _DDL)


def _tile_rows(path: str, content: bytes, kind: str, tile: int) -> pd.DataFrame:
    columns = [c.strip().split()[0] for c in _DDL.split(",")]
    try:
        if kind not in _DECODERS:
            raise ValueError(f"no reader for {kind}")
        a, facts, channels = _DECODERS[kind](bytes(content))
        h, w, _ = a.shape
        head = (channels, w, h, *facts, None)
        rows = [(path, 0, c, y0 // tile, x0 // tile, y0, x0, min(tile, h - y0), min(tile, w - x0),
                 np.ascontiguousarray(a[y0:y0 + tile, x0:x0 + tile, c]).ravel().astype(np.float32), *head)
                for c in range(a.shape[2]) for y0 in range(0, h, tile) for x0 in range(0, w, tile)]
    except Exception as exc:  # any malformed file belongs in quarantine
        rows = [(path, *[None] * (len(columns) - 2), f"{type(exc).__name__}: {exc}")]
    return pd.DataFrame(rows, columns=columns)


def ingest(files: DataFrame, tile: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles, plane headers and quarantine rows. Write the decoded rows once when all three
    are needed, so files are not decoded three times."""
    d = decode(files, tile)
    ok = d.where("error is null")
    planes = ok.where("channel = 0 and ty = 0 and tx = 0").select(
        "image_id", "page", "channels", "width", "height", "sample_format", "bits", "type_min", "type_max", "numeric_type")
    return (ok.select("image_id", "page", "channel", "ty", "tx", "y0", "x0", "h", "w", "data"), planes,
            d.where("error is not null").select(F.col("image_id").alias("path"), "error"))


def tiles_to_samples(tiles: DataFrame) -> DataFrame:
    return tiles.select("image_id", "page", "channel", "y0", "x0", "w", F.posexplode("data").alias("i", "value")).select(
        "image_id", "page", "channel", F.expr("y0 + i div w").cast("int").alias("y"), F.expr("x0 + i % w").cast("int").alias("x"),
        F.col("value").cast("double").alias("value"))

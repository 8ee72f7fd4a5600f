"""Connected components of masks of any size.

1. Pixels are grouped into fixed-size tiles and labelled inside each tile (one bounded
   Arrow group per tile).
2. Only pixels on tile borders are joined with their neighbours in other tiles, which gives
   the edges of a much smaller component graph.
3. The graph is contracted by alternating large-star and small-star steps, all DataFrame
   joins and aggregates, with a reliable checkpoint per round; the number of rounds grows
   with the logarithm of the longest chain of tile components.
4. Components get dense labels in raster order of their first pixel; ranks are counted per
   band of lines and shifted by the bands before, so no task ranks a whole plane.

A pixel position is one integer ``y * 2^32 + x`` whose order is the raster order of a plane
of any width.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planeweave.schema import PLANE
from planeweave.session import cut_lineage

ROW = 1 << 32


def position(y: str = "y", x: str = "x"):
    return F.col(y).cast("long") * F.lit(ROW) + F.col(x).cast("long")


def _label_grid(on: np.ndarray, eight: bool) -> np.ndarray:
    """Smallest flat index of each pixel's component: hook roots to smaller neighbours and
    jump pointers until nothing moves."""
    h, w = on.shape
    n = h * w
    root = np.where(on.ravel(), np.arange(n), n)
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    pairs = []
    grid = np.arange(n).reshape(h, w)
    for dy, dx in shifts:
        a = grid[:h - dy, max(0, -dx):w - max(0, dx)].ravel()
        b = grid[dy:, max(0, dx):w - max(0, -dx)].ravel()
        both = on.ravel()[a] & on.ravel()[b]
        pairs.append(np.stack([a[both], b[both]]))
    a, b = np.concatenate(pairs, axis=1)
    root = np.append(root, n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root[:n].reshape(h, w)
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


def tile_components(mask: DataFrame, connectivity: int = 8, tile: int = 64, keys: list[str] = PLANE) -> DataFrame:
    """``(keys, y, x, node)``: node is the first position of the component inside its tile."""
    eight = connectivity != 4
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema.fields}
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", y int, x int, node bigint"
    m = mask.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).withColumn(
        "_ty", F.expr(f"y div {tile}")).withColumn("_tx", F.expr(f"x div {tile}"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf.y.to_numpy(), pdf.x.to_numpy()
        y0, x0 = y.min(), x.min()
        on = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1), dtype=bool)
        on[y - y0, x - x0] = True
        first = _label_grid(on, eight)[y - y0, x - x0]
        node = (first // on.shape[1] + y0).astype(np.int64) * ROW + (first % on.shape[1] + x0)
        return pdf[[*keys, "y", "x"]].assign(node=node)

    return m.groupBy(*keys, "_ty", "_tx").applyInPandas(kernel, ddl)


def _border_edges(nodes: DataFrame, connectivity: int, tile: int, keys: list[str]) -> DataFrame:
    """Pairs of tile components that touch across a tile border."""
    last = tile - 1
    rim = nodes.where(f"y % {tile} in (0, {last}) or x % {tile} in (0, {last})")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity != 4 else [])
    ask = rim.select(*keys, F.col("node").alias("u"), F.col("y").alias("_y"), F.col("x").alias("_x"),
                     F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("s"))
    ask = ask.select(*keys, "u", (F.col("_y") + F.col("s.dy")).alias("y"), (F.col("_x") + F.col("s.dx")).alias("x"), "_y", "_x")
    ask = ask.where(f"y div {tile} <> _y div {tile} or x div {tile} <> _x div {tile}").drop("_y", "_x")
    got = ask.join(rim.select(*keys, "y", "x", F.col("node").alias("v")), [*keys, "y", "x"])
    return got.where("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _both_ways(e: DataFrame, keys: list[str]) -> DataFrame:
    return e.select(*keys, "u", "v").unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))


def contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, u, v)`` with v the smallest node connected to u, for every u that is not it.

    Minima combine before their shuffle; the join back is an equi-join that adaptive
    execution splits when one node has very many neighbours.
    """
    def fingerprint(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first())

    e = cut_lineage(edges)
    mark = fingerprint(e)
    while mark[0]:
        # Large star: send every larger neighbour of a node to the smallest one.
        both = _both_ways(e, keys)
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(
            *keys, F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        # Small star: send every smaller neighbour, and the node itself, to the smallest.
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select(*keys, "u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut_lineage(small)
        new = fingerprint(e)
        if new == mark:
            break
        mark = new
    return e


def _roots(mask: DataFrame, connectivity: int, tile: int, keys: list[str]) -> DataFrame:
    nodes = cut_lineage(tile_components(mask, connectivity, tile, keys))
    links = contract(_border_edges(nodes, connectivity, tile, keys), keys)
    return nodes.join(links.select(*keys, F.col("u").alias("node"), F.col("v").alias("_to")), [*keys, "node"], "left").select(
        *keys, "y", "x", F.coalesce("_to", "node").alias("root"))


def dense_labels(roots: DataFrame, keys: list[str], band: int = 256) -> DataFrame:
    """``(keys, root, label)``: 1, 2, ... in raster order of the first pixel."""
    r = roots.select(*keys, "root").distinct().withColumn("_band", F.expr(f"root div {ROW * band}"))
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    shift = r.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("n")).select(
        *keys, "_band", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("_shift"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_band").orderBy("root"))
    return r.withColumn("_r", rank).join(shift, [*keys, "_band"]).select(
        *keys, "root", (F.col("_r") + F.col("_shift")).alias("label"))


def label_components(mask: DataFrame, connectivity: int = 8, tile: int = 64, keys: list[str] = PLANE) -> DataFrame:
    """Mask pixels with dense component labels per key; any connectivity but 4 means 8."""
    roots = _roots(mask, connectivity, tile, keys)
    return roots.join(dense_labels(roots, keys), [*keys, "root"]).select(*keys, "y", "x", "label")


def count_components(mask: DataFrame, connectivity: int, keys: list[str], tile: int = 64) -> DataFrame:
    """Number of components and pixels per key, without labelling pixels: tile components
    minus the merges across tile borders."""
    nodes = cut_lineage(tile_components(mask, connectivity, tile, keys))
    links = contract(_border_edges(nodes, connectivity, tile, keys), keys)
    merged = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    own = nodes.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("_p")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("pixels"))
    return own.join(merged, list(keys), "left").select(
        *keys, (F.col("_n") - F.coalesce("_m", F.lit(0).cast("long"))).alias("object_count"), "pixels")

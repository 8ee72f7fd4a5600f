"""Component counts of all thresholds from one merge tree.

Lowering a threshold, pixels appear and components merge. On the graph of neighbouring pixels, where an edge
appears with the lower of its two ends, the components at a threshold are the pixels present less the edges
of a maximum spanning forest present. So one forest answers every threshold at once.

Forests are built in tiles, then in squares of four tiles, and so on. Most merges inside a square cannot be
changed by anything outside: a merge is settled as soon as one of both sides has no pixel on the square's
border. Each square hands up its border pixels, the unsettled merges as edges between border pixels, and
counts of the settled ones; a group's size follows the border's length, not the area.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.operators.components import ROW, position
from planeweave.schema import PLANE

VERTEX, EDGE, SETTLED = 0, 1, 2
_DDL = "ty int, tx int, kind int, u long, v long, level int, pixels long, merges long"


def levels_of(plane: DataFrame, cuts: DataFrame, dark_background: bool = True) -> DataFrame:
    """``(plane, y, x, level)``: how many of the plane's ascending ``cuts`` select the pixel; pixels that none
    selects are left out."""
    v = F.col("value")
    test = (lambda t: v >= t) if dark_background else (lambda t: v <= t)
    px = plane.where(F.abs("value") < float("inf")).join(cuts.select(*PLANE, "cuts"), PLANE)
    return px.select(*PLANE, "y", "x", F.size(F.filter("cuts", test)).alias("level")).where("level > 0")


def _forest(n: int, edges: list[tuple[int, int, int]], rim: np.ndarray):
    """Kruskal from the highest level down over ``(level, a, b)``: unsettled merges as edges between rim
    vertices, and the number of settled merges of each level."""
    parent, stands = list(range(n)), [i if on else -1 for i, on in enumerate(rim.tolist())]
    kept, settled = [], Counter()
    for level, a, b in sorted(edges, reverse=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a == b:
            continue
        ra, rb = stands[a], stands[b]
        if ra >= 0 and rb >= 0:
            kept.append((level, ra, rb))
        else:
            settled[level] += 1
        parent[b] = a
        stands[a] = max(ra, rb)
    return kept, settled


def _on_rim(u: np.ndarray, size: int) -> np.ndarray:
    """Positions with a neighbour in another square of that size, to the left or above or possibly beyond."""
    y, x = u // ROW, u % ROW
    return ((y % size == 0) & (y > 0)) | (y % size == size - 1) | ((x % size == 0) & (x > 0)) | (x % size == size - 1)


def _rows(u: np.ndarray, level: np.ndarray, edges: list, size: int, pixels: Counter, merges: Counter) -> pd.DataFrame:
    """What a square hands up, from its vertices, edges by vertex index and counts so far."""
    rim = _on_rim(u, size)
    kept, settled = _forest(len(u), edges, rim)
    merges = merges + settled
    out = [(VERTEX, p, p, w, 0, 0) for p, w in zip(u[rim].tolist(), level[rim].tolist())]
    out += [(EDGE, int(u[a]), int(u[b]), w, 0, 0) for w, a, b in kept]
    out += [(SETTLED, 0, 0, w, pixels[w], merges[w]) for w in sorted({*pixels, *merges})]
    return pd.DataFrame(out, columns=["kind", "u", "v", "level", "pixels", "merges"])


def _steps(u: np.ndarray, level: np.ndarray, across: int | None) -> list[tuple[int, int, int]]:
    """Edges between 4-neighbours; with ``across``, only those between different squares of that size."""
    order = np.argsort(u)
    found = []
    for step, cut in ((1, lambda p: p % ROW), (ROW, lambda p: p // ROW)):
        at = np.searchsorted(u, u + step, sorter=order)
        other = order[np.minimum(at, len(u) - 1)]
        ok = u[other] == u + step
        if across is not None:
            ok &= cut(u) // across != cut(u + step) // across
        a, b = np.flatnonzero(ok), other[ok]
        found += zip(np.minimum(level[a], level[b]).tolist(), a.tolist(), b.tolist())
    return found


def merge_counts(levels: DataFrame, side: int, tile: int = 64) -> DataFrame:
    """``(plane, level, pixels, merges)`` per level from ``(plane, y, x, level)`` rows; planes are at most
    ``side`` pixels wide and high. 4-connected."""
    kinds = dict(levels.dtypes)
    keys = [*PLANE, "ty", "tx"]
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in PLANE) + ", " + _DDL

    def tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        u, level = pdf.u.to_numpy(np.int64), pdf.level.to_numpy(np.int64)
        out = _rows(u, level, _steps(u, level, None), tile, Counter(level.tolist()), Counter())
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})

    def squares(size: int):
        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            kind = pdf.kind.to_numpy()
            u, level = pdf.u.to_numpy(np.int64)[kind == VERTEX], pdf.level.to_numpy(np.int64)[kind == VERTEX]
            pixels, merges = Counter(), Counter()
            for w, p, m in pdf.loc[kind == SETTLED, ["level", "pixels", "merges"]].itertuples(index=False):
                pixels[w] += p
                merges[w] += m
            index = {p: i for i, p in enumerate(u.tolist())}
            old = pdf.loc[kind == EDGE, ["level", "u", "v"]].itertuples(index=False)
            edges = [(w, index[a], index[b]) for w, a, b in old] + (_steps(u, level, size // 2) if len(u) else [])
            return _rows(u, level, edges, size, pixels, merges).assign(**{k: pdf[k].iloc[0] for k in keys})
        return merged

    at = {"ty": F.expr(f"y div {tile}").cast("int"), "tx": F.expr(f"x div {tile}").cast("int")}
    out = levels.withColumns(at).select(*keys, position().alias("u"), "level").groupBy(*keys).applyInPandas(tiles, ddl)
    size = tile
    while size < side:
        size *= 2
        out = out.withColumns({"ty": F.expr("ty div 2").cast("int"), "tx": F.expr("tx div 2").cast("int")}).groupBy(*keys).applyInPandas(squares(size), ddl)
    # Edges that reached the top are merges too; nothing lies outside any more.
    return out.where(F.col("kind") != VERTEX).groupBy(*PLANE, "level").agg(
        F.sum("pixels").alias("pixels"), F.sum(F.when(F.col("kind") == EDGE, 1).otherwise(F.col("merges"))).alias("merges"))


def counts_at(counts: DataFrame, samples: int) -> DataFrame:
    """``(plane, rank, object_count, pixels)`` for each number of cuts that a pixel must satisfy, 1 to
    ``samples`` (128 at most)."""
    g = counts.groupBy(*PLANE).agg(F.collect_list(F.struct("level", "pixels", "merges")).alias("c"))

    def over(value) -> Column:
        return F.aggregate(F.filter("c", lambda r: r["level"] >= F.col("rank")), F.lit(0).cast("long"), lambda a, r: a + value(r))

    g = g.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    return g.select(*PLANE, "rank", over(lambda r: r["pixels"] - r["merges"]).alias("object_count"), over(lambda r: r["pixels"]).alias("pixels"))

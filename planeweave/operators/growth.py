"""Region growing as minimax paths.

A seed reaches a pixel at a tolerance when some path of neighbouring pixels never strays further than that
from the seed's value. The least such tolerance of each pixel is the smallest, over all paths, of the
largest deviation on the way; one propagation finds it, and the areas of all tolerances of a sweep follow
from a histogram of these costs.

The propagation runs in fixed-size tiles. A tile is worked on when a seed lies in it or a cheaper cost has
reached its border; it then spreads the costs inside (cheapest pixel first) and sends what its own border
gained to the neighbours. The rounds end when no border gains anything. So each seed touches the tiles that
its region reaches and no others, and no task holds more than a tile at a time.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planeweave.functions.numeric import finite
from planeweave.operators import neighbourhood as N
from planeweave.schema import PIXEL, PLANE
from planeweave.session import cut_lineage, rows_per_batch

SEED = [*PLANE, "seed_id"]
TILE = [*PLANE, "ty", "tx"]
#: Rounds after which the rows of earlier rounds are reduced to the newest of each seed and tile.
COMPACT = 8
#: Seeds that a kernel holds at once, each with its tile's values and costs.
AT_ONCE = 32
_FACTS = ("areas", "x0", "x1", "y0", "y1")


def _offsets(connectivity: int) -> list[tuple[int, int]]:
    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    return four if connectivity == 4 else [*four, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def spread(cost: np.ndarray, reached: np.ndarray, start: list[tuple[float, int, int]], limit: float, connectivity: int = 8,
           stop: float | None = None) -> np.ndarray:
    """Minimax costs of a tile after the ``(cost, y, x)`` arrivals of ``start``; ``reached`` holds what was
    known before (infinite where nothing was). Pixels above ``limit`` stay infinite. With ``stop``, ends
    once so many pixels are done; those left out cost no less than any that is done."""
    h, w = cost.shape
    wide = w + 2
    own = np.full((h + 2, wide), np.inf)
    own[1:-1, 1:-1] = cost
    known = np.full((h + 2, wide), np.inf)
    known[1:-1, 1:-1] = reached
    c, best = own.ravel().tolist(), known.ravel().tolist()
    steps = [dy * wide + dx for dy, dx in _offsets(connectivity)]
    heap: list[tuple[float, int]] = []
    for d, y, x in start:
        i = (y + 1) * wide + x + 1
        d = max(d, c[i])
        if d <= limit and d < best[i]:
            best[i] = d
            heapq.heappush(heap, (d, i))
    done = 0
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        done += 1
        if stop is not None and done > stop:
            break
        for s in steps:
            j = i + s
            e = c[j]
            if e < d:
                e = d
            if e <= limit and e < best[j]:
                best[j] = e
                heapq.heappush(heap, (e, j))
    return np.array(best).reshape(h + 2, wide)[1:-1, 1:-1]


def _facts(best: np.ndarray, tolerances: np.ndarray, y0: int, x0: int) -> dict[str, list]:
    """Per tolerance: pixels reached and their box, in plane coordinates."""
    out: dict[str, list] = {k: [] for k in _FACTS}
    for t in tolerances:
        on = best <= t
        ys, xs = np.flatnonzero(on.any(1)), np.flatnonzero(on.any(0))
        out["areas"].append(int(on.sum()))
        for k, v in (("y0", ys[:1] + y0), ("y1", ys[-1:] + y0), ("x0", xs[:1] + x0), ("x1", xs[-1:] + x0)):
            out[k].append(int(v[0]) if len(v) else None)
    return out


def _outgoing(before: np.ndarray, after: np.ndarray, ty: int, tx: int, tile: int, connectivity: int):
    """``(y, x, cost)`` arrays of pixels in other tiles that border pixels with a lower cost now touch."""
    ys, xs = np.nonzero(after < before)
    rim = (ys == 0) | (ys == tile - 1) | (xs == 0) | (xs == tile - 1)
    ys, xs = ys[rim], xs[rim]
    parts = [(ys + dy, xs + dx, after[ys, xs]) for dy, dx in _offsets(connectivity)]
    y, x, c = (np.concatenate(p) for p in zip(*parts))
    out = (y < 0) | (y >= tile) | (x < 0) | (x >= tile)
    y, x, c = y[out] + ty * tile, x[out] + tx * tile, c[out]
    inside = (y >= 0) & (x >= 0)
    return y[inside], x[inside], c[inside]


def _kinds(df: DataFrame, names: list[str]) -> str:
    found = dict(df.dtypes)
    return ", ".join(f"`{k}` {found[k]}" for k in names)


def reach(seeds: DataFrame, plane: DataFrame, planes: DataFrame, connectivity: int = 8, max_fraction: float = 0.5,
          sweep: bool = False, tile: int = 64) -> DataFrame:
    """``(seed, ty, tx)`` rows with the tile's costs and what it adds to each tolerance.

    Seeds carry ``tolerances``, an ascending array. In a sweep, tolerances whose area is above the plane's
    cap have leaked and only their leak counts, so costs from there on are not followed further.
    """
    values = plane.where(finite("value")).select(*PIXEL, F.col("value").cast("double").alias("value"))
    cap = planes.select(*PLANE, F.floor(F.col("width").cast("double") * F.col("height") * max_fraction).alias("cap"))
    at = {"ty": F.expr(f"y div {tile}").cast("int"), "tx": F.expr(f"x div {tile}").cast("int")}
    own = seeds.select(*SEED, "y", "x", "tolerances").join(values.withColumnRenamed("value", "v0"), PIXEL).join(cap, PLANE)
    place = F.expr(f"cast((y % {tile}) * {tile} + x % {tile} as int)")
    tiles = values.join(own.select(*PLANE).distinct(), PLANE, "left_semi").withColumns(at).groupBy(*TILE).agg(
        F.collect_list(F.struct(place.alias("i"), "value")).alias("_px")).select(*TILE, F.expr("_px.i").alias("px"), F.expr("_px.value").alias("v"))
    # Spread by number: partitions merged by their size in bytes would leave all seeds to a few tasks.
    parts = int(plane.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = cut_lineage(tiles)  # a row holds one tile
    facts = cut_lineage(own.select(*SEED, "v0", "tolerances", "cap", F.col("tolerances")[F.size("tolerances") - 1].alias("limit"), "y", "x"))
    work = facts.withColumns(at).select(*SEED, "ty", "tx", F.array("y").alias("my"), F.array("x").alias("mx"), F.array(F.lit(0.0)).alias("mc"))
    facts = facts.drop("y", "x")
    keys = [*SEED, "ty", "tx"]
    ddl = _kinds(work, keys) + ", costs array<double>, areas array<long>, x0 array<int>, x1 array<int>, y0 array<int>, y1 array<int>, oy array<int>, ox array<int>, oc array<double>"

    nothing_sent = {k: F.lit(None).cast(f"array<{t}>") for k, t in (("oy", "int"), ("ox", "int"), ("oc", "double"))}

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                tolerances = np.asarray(r.tolerances, float)
                cost = np.full(tile * tile, np.inf)
                cost[np.asarray(r.px, int)] = np.abs(np.asarray(r.v) - r.v0)
                cost = cost.reshape(tile, tile)
                before = np.full((tile, tile), np.inf) if r.costs is None else np.asarray(r.costs, float).reshape(tile, tile)
                start = [(c, y - r.ty * tile, x - r.tx * tile) for c, y, x in zip(r.mc, r.my, r.mx)]
                after = spread(cost, before, start, r.limit, connectivity, r.cap if sweep and r.costs is None else None)
                y, x, c = _outgoing(before, after, r.ty, r.tx, tile, connectivity)
                rows.append({**{k: getattr(r, k) for k in keys}, "costs": after.ravel(), **_facts(after, tolerances, r.ty * tile, r.tx * tile), "oy": y, "ox": x, "oc": c})
            if rows:
                yield pd.DataFrame(rows)

    rounds: list[DataFrame] = []
    done = 0
    while True:
        if len(rounds) == COMPACT:
            rounds = [cut_lineage(_latest(functools.reduce(DataFrame.unionByName, rounds)).withColumns({"round": F.lit(done), **nothing_sent}))]
        known = functools.reduce(DataFrame.unionByName, rounds) if rounds else None
        asked = work.join(facts, SEED).repartition(parts, *TILE).join(tiles.repartition(parts, *TILE), TILE)
        if known is None:
            asked = asked.withColumn("costs", F.lit(None).cast("array<double>"))
        else:
            asked = asked.join(known.join(work.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.max_by("costs", "round").alias("costs")), keys, "left")
        with rows_per_batch(asked.sparkSession, AT_ONCE):
            rounds.append(cut_lineage(asked.mapInPandas(run, ddl).withColumn("round", F.lit(done))))
        done += 1
        sent = rounds[-1].where(F.size("oc") > 0).select(*SEED, F.explode(F.arrays_zip("oy", "ox", "oc")).alias("m")).select(
            *SEED, F.col("m.oy").alias("y"), F.col("m.ox").alias("x"), F.col("m.oc").alias("c"))
        if sent.isEmpty():
            return _latest(functools.reduce(DataFrame.unionByName, rounds))
        if sweep:  # costs from the first leaked tolerance on lead nowhere
            total = totals(_latest(functools.reduce(DataFrame.unionByName, rounds))).join(facts.select(*SEED, "cap"), SEED)
            leak = total.groupBy(*SEED).agg(F.min(F.when(F.col("area") > F.col("cap"), F.col("step"))).alias("leak"))
            limits = facts.join(leak, SEED).select(*SEED, F.when(F.col("leak").isNull(), F.col("limit")).otherwise(
                F.coalesce(F.get("tolerances", F.col("leak") - 1), F.lit(-1.0))).alias("limit"))
            facts = cut_lineage(facts.drop("limit").join(limits, SEED))
            sent = sent.join(facts.select(*SEED, "limit"), SEED).where("c <= limit").drop("limit")
        m = sent.groupBy(*SEED, "y", "x").agg(F.min("c").alias("c")).withColumns(at).groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "c")).alias("m"))
        work = cut_lineage(m.join(tiles.select(*TILE), TILE, "left_semi").select(*keys, F.expr("m.y").alias("my"), F.expr("m.x").alias("mx"), F.expr("m.c").alias("mc")))
        if work.isEmpty():
            return _latest(functools.reduce(DataFrame.unionByName, rounds))


def _latest(rounds: DataFrame) -> DataFrame:
    """The newest row of each seed and tile."""
    keys = [*SEED, "ty", "tx"]
    return rounds.groupBy(*keys).agg(F.max_by(F.struct("costs", *_FACTS), "round").alias("s")).select(*keys, "s.*")


def totals(reached: DataFrame) -> DataFrame:
    """``(seed, step, area, bx, by, width, height)``: the regions of all tolerances, summed over tiles."""
    r = reached.select(*SEED, F.posexplode(F.arrays_zip(*_FACTS)).alias("step", "f")).select(*SEED, "step", "f.*")
    return r.groupBy(*SEED, "step").agg(
        F.sum("areas").alias("area"), F.min("x0").alias("bx"), F.min("y0").alias("by"), (F.max("x1") - F.min("x0") + 1).alias("width"),
        (F.max("y1") - F.min("y0") + 1).alias("height")).where("area > 0")


def members(reached: DataFrame, tile: int = 64) -> DataFrame:
    """``(seed, y, x, cost)``: every pixel that was reached, with the least tolerance that reaches it."""
    r = reached.select(*SEED, "ty", "tx", F.posexplode("costs").alias("i", "cost")).where(F.col("cost") < float("inf"))
    return r.select(*SEED, F.expr(f"ty * {tile} + i div {tile}").cast("int").alias("y"), F.expr(f"tx * {tile} + i % {tile}").cast("int").alias("x"), "cost")


def _with_noise(seeds: DataFrame, plane: DataFrame) -> DataFrame:
    return seeds.select(*SEED, "y", "x").join(N.local_noise(seeds, plane), SEED)


def _default_tolerance(seeds: DataFrame, plane: DataFrame, tolerance: float | None) -> DataFrame:
    if tolerance is not None:
        return seeds.select(*SEED, "y", "x", F.array(F.lit(float(tolerance))).alias("tolerances"))
    return _with_noise(seeds, plane).withColumn("tolerances", F.array(F.greatest(F.col("noise") * 3, F.lit(1e-9))))


def region_pixels(seeds: DataFrame, plane: DataFrame, planes: DataFrame, tolerance: float | None = None, connectivity: int = 8,
                  tile: int = 64) -> DataFrame:
    """Pixels of the region around each seed, with the least tolerance that would still include them."""
    return members(reach(_default_tolerance(seeds, plane, tolerance), plane, planes, connectivity, tile=tile), tile)


def grow_regions(seeds: DataFrame, plane: DataFrame, planes: DataFrame, tolerance: float | None = None,
                 connectivity: int = 8, max_fraction: float = 0.5, tile: int = 64) -> DataFrame:
    """Region around each ``(seed_id, plane, y, x)`` seed; default tolerance is 3 × local noise.

    A region above the area cap is reported whole with ``leaked = true``; cutting it at the
    cap would depend on a traversal order.
    """
    s = _default_tolerance(seeds, plane, tolerance)
    cap = planes.select(*PLANE, F.floor(F.col("width").cast("double") * F.col("height") * max_fraction).alias("cap"))
    return totals(reach(s, plane, planes, connectivity, max_fraction, tile=tile)).join(cap, PLANE).select(
        *SEED, "bx", "by", "width", "height", "area", (F.col("area") > F.col("cap")).alias("leaked"))


def grow_regions_auto(seeds: DataFrame, plane: DataFrame, planes: DataFrame, steps: int = 14, connectivity: int = 8,
                      max_fraction: float = 0.5, tile: int = 64) -> DataFrame:
    """Tolerance of each seed with the flattest growth of area, out of a geometric sweep.

    A leak ends the sweep. Regions under 12 pixels do not count as flat. With one or two
    candidates the last is taken; with none the default tolerance would apply and the seed
    is returned with a NULL step.
    """
    sweep = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.greatest(F.col("noise"), F.lit(1e-9)) * F.pow(F.lit(1.5), k))
    s = cut_lineage(_with_noise(seeds, plane).withColumn("tolerances", sweep))
    cap = planes.select(*PLANE, F.floor(F.col("width").cast("double") * F.col("height") * max_fraction).alias("cap"))
    r = totals(reach(s, plane, planes, connectivity, max_fraction, sweep=True, tile=tile)).join(cap, PLANE).join(
        s.select(*SEED, "tolerances"), SEED).withColumn("tolerance", F.get("tolerances", F.col("step")))
    w = Window.partitionBy(*SEED).orderBy("step")  # at most ``steps`` rows
    r = r.withColumn("_leak", F.max((F.col("area") > F.col("cap")).cast("int")).over(w)).where("_leak = 0")
    r = r.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SEED))).withColumn("_i", F.row_number().over(w))
    growth = (F.lead("area").over(w) - F.col("area")) / F.greatest(F.col("area"), F.lit(1).cast("long"))
    r = r.withColumn("_g", F.when(F.col("area") >= 12, growth))
    row = F.struct("step", "tolerance", "area")
    g = r.groupBy(*SEED).agg(
        F.max("_n").alias("_n"), F.min_by(row, F.when(F.col("_g").isNotNull(), F.struct("_g", "_i"))).alias("flat"),
        F.min_by(row, "_i").alias("first"), F.max_by(row, "_i").alias("last"))
    pick = F.when(F.col("_n") <= 2, F.col("last")).otherwise(F.coalesce("flat", "first"))
    return seeds.select(*SEED).join(g.select(*SEED, pick.alias("p")), SEED, "left").select(*SEED, "p.step", "p.tolerance", "p.area")

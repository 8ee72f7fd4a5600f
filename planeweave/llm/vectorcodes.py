"""Product codes of vectors: codebooks by rounds of assignment and integer means, nearest entries by
Orchard's search.

A vector's components become integers, floor(4096 x), and it is cut into equal parts, each with its own
codebook. All arithmetic is on integers, so sums do not depend on order and every rerun gives the same
codes. In each round tasks assign their rows and send one row of counts and sums for every used entry;
the driver holds the codebooks alone (parts x entries x components numbers).

Orchard's search keeps for every entry the list of all entries by distance. A vector starts at entry 0 and
walks its list; an entry that is nearer, or as near with a lower index, becomes the current one, and the
walk goes on in its list. Entries seen before are passed over. No entry further from the current one than
twice the vector's distance can be nearer, so the walk ends there: distances are compared as squares
against four times the square, which is exact. A block of vectors walks together, one step at a time.

Odd input: rows whose vector is null, or holds a null or non-finite component, have no row. So have rows
whose vector is not as long as that of the smallest kept vec_id, or where that length is no multiple of the
number of parts: they have no place in the codebooks. Components beyond +-2^15 count as +-2^15, which keeps
every sum of squares in 63 bits. Null vec_ids come after all others; rows alike in vec_id are ordered by
their components. Fewer rows than entries make as many entries. Other columns are ignored, a null label is
a label of its own, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from planeweave.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 15
#: Vectors of a block that walk together.
BLOCK = 4096


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x array<long>`` of the rows whose components are all finite numbers."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    held = lambda v: F.greatest(F.least(v.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return vectors.where(good).select("vec_id", "label", F.transform("embedding", lambda v: F.floor(held(v) * SCALE).cast("long")).alias("x"))


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry, all entries by squared distance from it (ties by index), and these distances."""
    d = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.take_along_axis(d, order, axis=1)


def orchard(x: np.ndarray, book: np.ndarray, lists: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of ``x``, ties to the lower index, and the squared distance."""
    order, apart = lists if lists is not None else neighbour_lists(book)
    n, k = len(x), len(book)
    current = np.zeros(n, np.int64)
    least = ((x - book[0]) ** 2).sum(1)
    at = np.zeros(n, np.int64)  # place in the current entry's list
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    walking = np.arange(n)
    while len(walking):
        walking = walking[at[walking] < k]
        c, p = current[walking], at[walking]
        on = apart[c, p] <= 4 * least[walking]
        walking, c, p = walking[on], c[on], p[on]
        candidate = order[c, p]
        at[walking] += 1
        new = ~visited[walking, candidate]
        rows, candidate = walking[new], candidate[new]
        visited[rows, candidate] = True
        d = ((x[rows] - book[candidate]) ** 2).sum(1)
        better = (d < least[rows]) | ((d == least[rows]) & (candidate < current[rows]))
        rows, candidate = rows[better], candidate[better]
        current[rows], least[rows], at[rows] = candidate, d[better], 0
    return current, least


def _blocks(pdf: pd.DataFrame, dims: int, parts: int):
    """Matrices (rows, parts, components) of at most BLOCK rows, with the rows' places."""
    places = np.flatnonzero(pdf.x.map(len).to_numpy() == dims) if len(pdf) else np.zeros(0, int)
    for a in range(0, len(places), BLOCK):
        own = places[a:a + BLOCK]
        yield own, np.stack(pdf.x.to_numpy()[own]).astype(np.int64).reshape(len(own), parts, dims // parts)


def first_entries(x: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks (parts, entries, components) of the smallest vec_ids' own parts; None without usable rows.
    The driver receives ``entries`` rows."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    head = x.orderBy(*order).select("x").limit(1).collect()
    if not head or len(head[0].x) % parts:
        return None
    dims = len(head[0].x)
    rows = x.where(F.size("x") == dims).orderBy(*order).select("x").limit(entries).collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), parts, dims // parts).transpose(1, 0, 2)


def refine(x: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every used entry to the floor of its parts' mean."""
    parts, entries, width = books.shape
    lists = [neighbour_lists(b) for b in books]

    def sums(batches):
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for pdf in batches:
            for _, block in _blocks(pdf, parts * width, parts):
                for part in range(parts):
                    code, _ = orchard(block[:, part], books[part], lists[part])
                    count[part] += np.bincount(code, minlength=entries)
                    np.add.at(total[part], code, block[:, part])
        p, e = np.nonzero(count)
        yield pd.DataFrame({"part": p, "entry": e, "n": count[p, e], "total": list(total[p, e])})

    local = x.select("x").mapInPandas(sums, "part long, entry long, n long, total array<long>")
    added = [F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)]
    out = books.copy()
    for row in local.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # parts x entries rows at most
        out[row.part, row.entry] = [row[f"t{i}"] // row.n for i in range(width)]
    return out


def train(x: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks after ``rounds`` rounds over all rows."""
    books = first_entries(x, parts, entries)
    for _ in range(rounds if books is not None else 0):
        refined = refine(x, books)
        if np.array_equal(refined, books):
            break  # a further round would give the same
        books = refined
    return books


def encode(x: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits a part, squared distances summed over the parts."""
    parts, _, width = books.shape
    lists = [neighbour_lists(b) for b in books]
    kinds = dict(x.dtypes)

    def codes(batches):
        for pdf in batches:
            for places, block in _blocks(pdf, parts * width, parts):
                found = [orchard(block[:, p], books[p], lists[p]) for p in range(parts)]
                code = np.stack([c for c, _ in found], axis=1)
                yield pdf.iloc[places][["vec_id", "label"]].assign(
                    code=["".join(f"{v:02x}" for v in row) for row in code], error=np.sum([d for _, d in found], axis=0))

    # Nullable integers would turn to floats in pandas: keys travel as text.
    texts = x.withColumns({"vec_id": F.col("vec_id").cast("string"), "label": F.col("label").cast("string")})
    out = texts.mapInPandas(codes, "vec_id string, label string, code string, error long")
    return out.withColumns({"vec_id": F.col("vec_id").cast(kinds["vec_id"]), "label": F.col("label").cast(kinds["label"])})


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()


def quantized(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row."""
    x = integer_vectors(vectors)
    books = train(x, parts, entries, rounds)
    if books is None:
        return x.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = stored(encode(x, books))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rounds by comparing every part with every entry."""
    steps = [f"""e AS (SELECT vec_id, label, embedding, len(embedding) AS dims, CAST(row_number() OVER (ORDER BY vec_id) AS INTEGER) - 1 AS k FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
             f"""px AS MATERIALIZED (SELECT vec_id, label, k, i // (dims // {PARTS}) AS part, i % (dims // {PARTS}) AS pos, CAST(floor(CAST(v AS DOUBLE) * {SCALE}) AS BIGINT) AS x
  FROM (SELECT vec_id, label, k, dims, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM e))""",
             f"b0 AS MATERIALIZED (SELECT part, k AS entry, pos, x AS c FROM px WHERE k < {ENTRIES})"]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(d) AS d, arg_min(entry, d * {ENTRIES} + entry) AS entry
  FROM (SELECT vec_id, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM px JOIN b{r} USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM px JOIN a{r} USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN c ELSE s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END END AS c
  FROM b{r} b LEFT JOIN m{r} USING (part, entry, pos))""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT f.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN e USING (vec_id) CROSS JOIN h"""


SQL = _sql()

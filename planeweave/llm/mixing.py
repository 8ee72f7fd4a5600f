"""Mixing sources to target weights: blocks of words apportioned to sources by Sainte-Lague's highest
quotients in every shard, then taken whole in seeded order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from planeweave.llm.common import WORD, fixed_hash, stored, whole

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SHARD = 1 << 20
SEED = "mix-2"
CELL = ["_src", "_part"]
_WORDS = re.compile(WORD)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)``: ``share`` of all words dealt by weight, none above
    ``most`` times its source.

    Water-filling in closed form: sources sorted by (cap / weight) are capped up to the first
    where the rest, dealt by weight, stays below every remaining cap. Works on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    per = per.withColumn("_level", rest / F.sum("_w").over(here))
    # The level that holds is that of the first source which it leaves below its cap.
    free = F.col("_level") * F.col("_w") < F.col("_cap")
    level = F.min(F.when(free, F.struct((F.col("_cap") / F.col("_w")).alias("k"), F.col("_level").alias("v")))).over(everything)
    per = per.withColumn("_at", level["v"])
    return per.select("source", "source_size", F.coalesce(
        F.least(F.col("_at") * F.col("_w"), F.col("_cap")), F.col("_cap")).cast("double").alias("target"))


def _block_count(words: str, block: int) -> str:
    """SQL for the number of blocks of a line of words: equal ones, as near to ``block`` words as may be."""
    return f"greatest(1, (2 * {words} + {block}) div {2 * block})"


def seats(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(_src, _part, seats)`` of cells ``(_shard, _src, _part, words, votes)``: the blocks that each may give.

    A shard has as many seats as its cells' votes (words to give) make blocks, rounded. A cell's k-th seat has
    the quotient votes / (2k - 1); the highest quotients of the shard win, ties go by source and part. A cell
    has two quotients for each of its blocks, since each may be taken twice. A shard's quotients number about
    two for every ``block`` of its words, so a window over one is bounded by the size of a shard.
    """
    turns = F.expr(_block_count("words", block)).cast("int") * 2
    q = cells.where("words > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), turns)))
    q = q.withColumn("_q", F.col("votes") / (2 * F.col("_k") - 1).cast("double"))
    size = cells.groupBy("_shard").agg(F.round(F.sum(F.round("votes").cast("long")) / F.lit(float(block))).cast("long").alias("_all"))
    best = Window.partitionBy("_shard").orderBy(F.col("_q").desc(), "_src", "_part", "_k")
    q = q.withColumn("_place", F.row_number().over(best)).join(size, "_shard")
    return q.where("_place <= _all").groupBy(*CELL).agg(F.count(F.lit(1)).alias("seats"))


def _taken(sizes: DataFrame, weights, share: float, most: float, block: int, shard: int, seed: str) -> DataFrame:
    """The pieces of documents that each block holds, with the words taken of them in the first and second pass.

    ``sizes`` has doc_id, source, size and _key, which tells rows of equal id apart.
    """
    goal = targets(sizes, weights, share, most)
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    goal = (F.broadcast(goal) if _few(goal) else goal).alias("g")
    rows = sizes.alias("d").join(goal, F.col("d.source").eqNullSafe(F.col("g.source")))
    rows = rows.select("doc_id", F.col("d.source").alias("source"), "size", "_key", "source_size", "target")
    parts = F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / F.lit(shard))
    rows = rows.withColumn("_draw", fixed_hash(F.lit(seed), "doc_id")).withColumns({
        "_part": F.pmod(F.col("_draw"), parts), "_src": F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))})
    cells = rows.groupBy(*CELL, "source", "source_size", "target").agg(F.sum("size").alias("words")).select(
        *CELL, "words", F.pmod(fixed_hash(F.lit(seed), "source") + F.col("_part"), F.lit(shards)).alias("_shard"),
        (F.col("target") * F.col("words") / F.greatest(F.col("source_size"), F.lit(1)).cast("double")).alias("votes"))
    rows = rows.join(seats(cells, block), CELL, "left")
    line = Window.partitionBy(*CELL).orderBy("_draw", "doc_id", "size", "_key")
    rows = rows.withColumn("_row", F.row_number().over(line)).withColumn(
        "_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_words", F.sum("size").over(Window.partitionBy(*CELL))).withColumn("_blocks", F.expr(_block_count("_words", block)))
    # Word w of the line stands in block w * blocks div words; an empty document at its end stands past the last.
    rows = rows.withColumn("_start", F.col("_end") - F.col("size")).withColumn("_block", F.explode(F.expr(
        "sequence(_start * _blocks div greatest(_words, 1), greatest(_end - 1, _start) * _blocks div greatest(_words, 1))")))
    low = F.expr("greatest(_start, (_block * _words + _blocks - 1) div _blocks)")
    high = F.expr("least(_end, ((_block + 1) * _words + _blocks - 1) div _blocks)")
    rows = rows.withColumns({"_from": low - F.col("_start"), "_n": high - low, "_turn": fixed_hash(F.lit(seed), F.col("source"), F.col("_part"), F.col("_block"))})
    place = F.dense_rank().over(Window.partitionBy(*CELL).orderBy(F.col("_block") >= F.col("_blocks"), "_turn", "_block"))
    rows = rows.withColumn("_place", place)
    won = F.coalesce("seats", F.lit(0))
    given = lambda needed: F.when(won >= needed, F.col("_n")).otherwise(0).cast("long")
    return rows.withColumns({"_once": given(F.col("_place")), "_twice": given(F.col("_place") + F.col("_blocks"))})


def _sizes(docs: DataFrame, key) -> DataFrame:
    return stored(docs.select("doc_id", "source", F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"), key.alias("_key")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
        shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    A source is split by a seeded hash of its documents into parts of about ``shard`` words, so no source,
    however large, is one group; a shard holds a part of each large source and the whole of some small ones.
    A part's documents, in seeded order, form a line of words cut into equal blocks of about ``block`` words. In each
    shard the highest quotients of Sainte-Lague win the parts' seats (:func:`seats`), and a part gives as many
    whole blocks as it has seats, in seeded order, a second time once all are given.

    A source comes within about half a block for each of its parts to its target; one whose target is below
    half a block may give nothing.

    Null text counts as empty and takes 0; a null source is a source, last in order; repeated
    rows each have their own words on the line. Without words all targets are 0.
    """
    rows = _taken(_sizes(docs, F.lit(0).cast("long")), weights, share, most, block, shard, seed)
    return rows.groupBy(*CELL, "_row", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.col("_once") + F.col("_twice")).alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts cut down to runs of their words, (first word, count) each; what stands between words of a run stays."""
    for batch in batches:
        texts = []
        for text, runs, size in zip(*(batch.column(c).to_pylist() for c in ("text", "__mix_runs", "__mix_size"))):
            if [tuple(r.values()) for r in runs] != [(0, size)]:
                spans = [m.span() for m in _WORDS.finditer(text)]
                text = "\n".join(text[spans[r["at"]][0]:spans[r["at"] + r["n"] - 1][1]] for r in runs)
            texts.append(text)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK,
                    shard: int = SHARD, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each pass in which words of a document are taken.

    The text of a row is the taken words' part of it, and ``n_chars``, where there is such a column,
    its length. Documents of which nothing is taken, empty ones among them, have no row.
    """
    key = F.xxhash64("doc_id", "source", "text")
    rows = _taken(_sizes(docs, key), weights, share, most, block, shard, seed)
    runs = rows.select(*CELL, "_row", "_key", "size", "_block", "_from", F.explode(F.array(
        F.struct(F.lit(1).alias("turn"), F.col("_once").alias("n")), F.struct(F.lit(2).alias("turn"), F.col("_twice").alias("n")))).alias("x"))
    runs = runs.where("x.n > 0").groupBy(*CELL, "_row", "_key", "size", "x.turn").agg(F.sort_array(F.collect_list(F.struct(
        F.col("_from").alias("at"), F.col("x.n").alias("n")))).alias("_runs"))
    # Neighbouring runs become one.
    runs = runs.withColumn("_runs", F.aggregate("_runs", F.array().cast("array<struct<at:bigint,n:bigint>>"), lambda done, r: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["at"] + F.element_at(done, -1)["n"] == r["at"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["at"].alias("at"), (F.element_at(done, -1)["n"] + r["n"]).alias("n"))))).otherwise(
        F.concat(done, F.array(r)))))
    # Rows alike in id, source and text share a key: the k-th of them takes the k-th entry.
    per_row = runs.groupBy(*CELL, "_row", "_key", "size").agg(F.collect_list("_runs").alias("_passes"))
    plan = per_row.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_row", "size", "_passes"))).alias("__mix_plan"))
    turn = Window.partitionBy("__mix_key").orderBy("doc_id")
    out = docs.withColumn("__mix_key", key).join(plan.withColumnRenamed("_key", "__mix_key"), "__mix_key").withColumn("__mix_mine", F.get("__mix_plan", F.row_number().over(turn) - 1))
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__mix_mine._passes").alias("__mix_runs"), F.col("__mix_mine.size").alias("__mix_size"))
    out = out.mapInArrow(_cut, out.schema).drop("__mix_runs", "__mix_size")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _few(goal: DataFrame, bound: int = 100_000) -> bool:
    """Whether the table of sources has at most ``bound`` rows, counted, and so may be broadcast."""
    return goal.limit(bound + 1).count() <= bound


def _md5_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce(CAST({p} AS VARCHAR), '~')" for p in parts)
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def sql(documents: str = "documents") -> str:
    """The same rows for DuckDB, with the default parameters."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)) AS w,
              source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, ((SELECT sum(source_size) FROM s1) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
g AS (SELECT source, source_size, CAST(coalesce(least((SELECT arg_min(level, cap / w) FROM s2 WHERE level * w < cap) * w, cap), cap) AS DOUBLE) AS target FROM s2),
r0 AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, {_md5_sql(f"'{SEED}'", 'd.doc_id')} AS draw
       FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r1 AS (SELECT *, draw % CAST(ceil(greatest(source_size, 1) / {SHARD}::DOUBLE) AS BIGINT) AS part, coalesce('0' || source, '1') AS src FROM r0),
c0 AS (SELECT src, part, any_value(source) AS source, sum(size)::BIGINT AS words, any_value(target) * sum(size)::BIGINT / CAST(greatest(any_value(source_size), 1) AS DOUBLE) AS votes FROM r1 GROUP BY src, part),
c1 AS (SELECT *, ({_md5_sql(f"'{SEED}'", 'source')} + part) % greatest(1, CAST(ceil((SELECT sum(source_size) FROM g) / {SHARD}::DOUBLE) AS BIGINT)) AS shard FROM c0),
c2 AS (SELECT *, unnest(range(1, 2 * greatest(1, (2 * words + {BLOCK}) // {2 * BLOCK}) + 1)) AS k FROM c1 WHERE words > 0),
c3 AS (SELECT c2.*, row_number() OVER (PARTITION BY c2.shard ORDER BY votes / CAST(2 * k - 1 AS DOUBLE) DESC, src, part, k) AS place, seats_all
       FROM c2 JOIN (SELECT shard, CAST(round(sum(CAST(round(votes) AS BIGINT)) / {BLOCK}::DOUBLE) AS BIGINT) AS seats_all FROM c1 GROUP BY shard) USING (shard)),
st AS (SELECT src, part, count(*) AS seats FROM c3 WHERE place <= seats_all GROUP BY src, part),
r2 AS (SELECT *, row_number() OVER l AS rn, sum(size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e,
              CAST(sum(size) OVER (PARTITION BY src, part) AS BIGINT) AS words
       FROM r1 WINDOW l AS (PARTITION BY src, part ORDER BY draw, doc_id NULLS FIRST, size)),
r3 AS (SELECT *, CAST(e AS BIGINT) AS en, CAST(e AS BIGINT) - size AS sn, greatest(1, (2 * words + {BLOCK}) // {2 * BLOCK}) AS blocks FROM r2),
b AS (SELECT *, unnest(range(sn * blocks // greatest(words, 1), greatest(en - 1, sn) * blocks // greatest(words, 1) + 1)) AS block FROM r3),
p AS (SELECT *, least(en, ((block + 1) * words + blocks - 1) // blocks) - greatest(sn, (block * words + blocks - 1) // blocks) AS n, {_md5_sql(f"'{SEED}'", 'source', 'part', 'block')} AS turn FROM b),
q AS (SELECT *, dense_rank() OVER (PARTITION BY src, part ORDER BY block >= blocks, turn, block) AS place FROM p)
SELECT doc_id, size, source_size, target,
       CAST(sum(n * (CASE WHEN seats >= place THEN 1 ELSE 0 END + CASE WHEN seats >= place + blocks THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM q LEFT JOIN st USING (src, part) GROUP BY src, part, rn, doc_id, size, source_size, target"""


SQL = sql()

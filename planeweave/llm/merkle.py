"""Merkle manifest of a documents table, with inclusion proofs by pointer jumping.

Every row is a leaf. The leaves of a language, by doc_id, are hashed in runs of eight, the results again,
until one is left: the subroot. The subroots, by language, give the root in the same way.

Ranks: rows are dealt by ranges of (language, doc_id), numbered inside their partition, and shifted by the
counts of the partitions before; no task ranks a whole language. A level is one aggregate of runs.

Proofs: every inner node knows its parent and the siblings that it needs there. In each round a node's
pointer meets the node it points to and takes over that node's pointer, while the two segments of siblings
are joined: the distance doubles, and after log2(depth) rounds all point past the root. Leaves take the last
jump, over the whole segment of their parent; eight of them meet one parent, so no key is hot.

A digest H is lower-case hex SHA-256 of its inputs in a row, digests as hex text.

Odd input: a null field is ``-``, any other its size in UTF-8 bytes, ``:`` and its value. Null languages and
null doc_ids come before all others. Rows alike in language and doc_id are ordered by their leaf; rows that
are alike in all fields are leaves of their own. A null doc_id is never tampered with. One document alone is
its own root and has no siblings: its proof is H of nothing. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from planeweave.llm.common import stored

RUN = 8
TOP = "top"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<l:string,r:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, tree, leaf, changed``: the language as a key that sorts as languages do, null first; the
    row's digest; and its digest after tampering, which lower-cases A-Z of the text where ``tampered``
    (by default: where 3 divides the CRC-32 of doc_id's decimal digits)."""
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = digest(*head, field(F.col("text")))
    lower = digest(*head, field(F.translate("text", UPPER, LOWER)))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    return documents.select("doc_id", tree.alias("tree"), leaf.alias("leaf"), F.when(tampered, lower).alias("changed"))


def ranked(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """The rows with ``pos``, 0, 1, ... in each tree by the order columns (nulls first; full ties in any
    order), and ``n``, the tree's number of rows. ``rows`` should be a stored table, since it is read twice."""
    split = 1 << 33
    by = [F.col(tree), *[F.col(c) for c in order]]
    width = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # The last key spreads rows that tie in all others.
    dealt = rows.withColumn("_tie", F.rand(13)).repartitionByRange(int(width), *by, "_tie").sortWithinPartitions(*by)
    dealt = stored(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    block = F.expr(f"_at div {split}L")
    found = dealt.groupBy(tree, block.alias("_block")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # One row per partition and tree; a tree's rows lie in consecutive partitions.
    every = Window.partitionBy(tree)
    before = every.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = found.select(tree, "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_n").over(every).alias("n"))
    out = dealt.withColumn("_block", block).join(shift, [tree, "_block"])
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_block", "_shift")


def _id(tree: Column, level: Column, pos: Column) -> Column:
    return F.concat_ws("/", level.cast("string"), pos.cast("string"), tree)


def _run_up(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of the next level: ``tree, pos, n, level, kids, h``, from ``tree, pos, n, h``."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda k: k["h"])  # eight at most
    up = nodes.where("n > 1").groupBy("tree", "n", F.expr(f"pos div {RUN}").alias("_up")).agg(kids.alias("kids"))
    return up.select("tree", F.col("_up").alias("pos"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), F.lit(level).alias("level"), "kids",
                     digest(F.array_join("kids", "")).alias("h"))


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Inner levels above the given leaves (``tree, pos, n, h``), each a stored table an eighth as large."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out, level = [], 0
    while most > 1:
        level, most = level + 1, -(-most // RUN)
        nodes = stored(_run_up(nodes, level))
        out.append(nodes)
    return out


def _step(kids: Column, place: Column) -> Column:
    """Siblings to the left and to the right of the run's node at a place, each in one text."""
    p = place.cast("int")
    return F.struct(F.array_join(F.slice(kids, F.lit(1), p), "").alias("l"),
                    F.array_join(F.slice(kids, p + 2, F.greatest(F.size(kids) - p - 1, F.lit(0))), "").alias("r"))


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, changed, subroot, root, path`` per row; path is the array of sibling texts (l, r)
    from the leaf to the root."""
    base = stored(ranked(stored(leaves(documents, tampered)), "tree", "doc_id", "leaf"))
    inner = _levels(base.select("tree", "pos", "n", F.col("leaf").alias("h")))
    single = base.where("n = 1").select("tree", F.col("leaf").alias("h"))
    subroots = single
    for level in inner:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "h"))
    tops = stored(ranked(stored(subroots.select(F.lit(TOP).alias("whole"), F.col("tree").alias("lang_key"), "h")), "whole", "lang_key"))
    upper = _levels(tops.select(F.col("whole").alias("tree"), "pos", "n", "h"))
    # A table of no rows has no root either.
    root = (upper[-1] if upper else tops).select("h").first()
    trees = tops.select(F.col("lang_key").alias("tree"), F.col("h").alias("subroot"), F.col("pos").alias("_rank"), (F.col("n") > 1).alias("_many"))

    # Where each node goes: one level up, from a subroot to the first level of the top tree, or nowhere.
    in_top = F.when(F.col("_many"), _id(F.lit(TOP), F.lit(1), F.expr(f"_rank div {RUN}")))

    def pointer(nodes: DataFrame, level: Column) -> DataFrame:
        n = nodes.join(trees, "tree")
        return n.withColumns({"to": F.when(F.col("n") > 1, _id(F.col("tree"), level + 1, F.expr(f"pos div {RUN}"))).otherwise(in_top),
                              "place": F.when(F.col("n") > 1, F.col("pos") % RUN).otherwise(F.col("_rank") % RUN)})

    up = F.when(F.col("n") > 1, _id(F.lit(TOP), F.col("level") + 1, F.expr(f"pos div {RUN}")))
    links = [pointer(x, F.col("level")).drop("subroot", "_rank", "_many") for x in inner]
    links += [x.withColumns({"to": up, "place": F.col("pos") % RUN}) for x in upper]
    links = [x.select(_id(F.col("tree"), F.col("level"), F.col("pos")).alias("id"), "to", "place", "kids") for x in links]
    leaf = pointer(base, F.lit(0))
    nothing = F.array().cast(f"array<{_STEP}>")
    whole = F.lit(root.h if root else None).cast("string").alias("root")
    if not links:  # every language has one document, and there is one language at most
        return leaf.select("doc_id", "leaf", "changed", "subroot", whole, nothing.alias("path"))
    table = stored(functools.reduce(DataFrame.unionByName, links))
    runs = table.select(F.col("id").alias("to"), F.col("kids").alias("_kids"))
    state = table.join(runs, "to", "left").select("id", "to", F.when(F.col("_kids").isNull(), nothing).otherwise(
        F.array(_step(F.col("_kids"), F.col("place")))).alias("path"))
    for _ in range(math.ceil(math.log2(max(2, len(links))))):
        state = stored(state)
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("_next"), F.col("path").alias("_rest"))
        state = state.join(ahead, "to", "left").select("id", F.col("_next").alias("to"), F.concat("path", F.coalesce("_rest", nothing)).alias("path"))
    proofs = stored(state.join(table.select("id", "kids"), "id").select(F.col("id").alias("to"), "kids", F.col("path").alias("_rest")))
    out = leaf.join(proofs, "to", "left")
    path = F.when(F.col("kids").isNull(), nothing).otherwise(F.concat(F.array(_step(F.col("kids"), F.col("place"))), "_rest"))
    return out.select("doc_id", "leaf", "changed", "subroot", whole, path.alias("path"))


def proof_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))


def verified(documents: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row."""
    m = manifest(documents)
    out = m.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                   folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(depth: int = 8, top_depth: int = 3) -> str:
    """Level by level for all leaves; ``depth`` levels hold 8^depth documents a language."""
    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    crc = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))"""
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    steps = ["""ct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)))""",
             f"""lf AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf_of('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % 3 = 0 THEN {leaf_of(lowered)} END AS changed FROM documents CROSS JOIN ct)""",
             """l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos0, count(*) OVER (PARTITION BY tree) AS n FROM lf)""",
             "n0 AS MATERIALIZED (SELECT tree, pos0 AS pos, leaf AS h, n FROM l0)"]

    def level(name: str, at: int) -> list[str]:
        a, b, s = f"{name}{at}", f"{name}{at + 1}", f"{name}s{at}"
        w = f"OVER (PARTITION BY tree, pos // {RUN} ORDER BY pos ROWS BETWEEN"
        return [f"""{s} AS MATERIALIZED (SELECT tree, pos, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l,
    CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {a})""",
                f"""{b} AS MATERIALIZED (SELECT tree, CASE WHEN n > 1 THEN pos // {RUN} ELSE pos END AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
    (any_value(n) + {RUN - 1}) // {RUN} AS n FROM {a} GROUP BY tree, CASE WHEN n > 1 THEN pos // {RUN} ELSE pos END)"""]

    for at in range(depth):
        steps += level("n", at)
    steps.append(f"q0 AS MATERIALIZED (SELECT 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS lang_key FROM n{depth})")
    for at in range(top_depth):
        steps += level("q", at)
    f0 = "SELECT l0.doc_id, leaf, coalesce(changed, leaf) AS f, '' AS proof, tree, pos0 FROM l0"
    steps.append(f"f0 AS MATERIALIZED ({f0})")
    fold = "CASE WHEN l IS NULL THEN f ELSE sha256(l || f || r) END AS f, proof || coalesce(l || r, '') AS proof"
    for at in range(depth):
        steps.append(f"f{at + 1} AS MATERIALIZED (SELECT doc_id, leaf, {fold}, f{at}.tree, pos0 FROM f{at} JOIN ns{at} s ON s.tree = f{at}.tree AND s.pos = pos0 // {RUN ** at})")
    steps.append(f"g0 AS MATERIALIZED (SELECT doc_id, leaf, f, proof, q0.h AS subroot, q0.pos AS rank FROM f{depth} JOIN q0 ON q0.lang_key = f{depth}.tree)")
    for at in range(top_depth):
        steps.append(f"g{at + 1} AS MATERIALIZED (SELECT doc_id, leaf, {fold}, subroot, rank FROM g{at} JOIN qs{at} s ON s.pos = rank // {RUN ** at})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM g{top_depth} CROSS JOIN q{top_depth}"""


SQL = _sql()

"""Document fingerprints by spot signatures, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from planeweave.llm.common import whole

#: The anchors, very common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is it for that was on are with as be at by this from or an a "
    "der die das und in zu den von mit ist des im dem nicht ein eine als auch auf "
    "le la les de et un une des en que qui dans est pour sur avec par au du "
    "el los del y es con para su se no lo como"
).split()
#: Content words in a chain.
CHAIN = 2
#: Rows of the table of buckets' first documents, which is broadcast.
BUCKETS = 100_000
BUCKET_IDS = 4_096


def spot_words(text: Column) -> Column:
    """Lower-case words without punctuation."""
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted distinct signatures of a non-null text column, as 64-bit numbers.

    A signature is an anchor and the next CHAIN words after it that are no anchors; of several
    anchors before the same chain the last counts. A text without a signature has one, of its
    whole word sequence, so that equal texts always agree and others do not.
    """
    w, at = f"{out}__w", f"{out}__at"
    is_anchor = lambda x: x.isin(*dict.fromkeys(ANCHORS))
    df = df.withColumn(w, spot_words(F.col(text)))
    # Places of content words. The word before one is an anchor if it is no content word itself.
    df = df.withColumn(at, F.filter(F.transform(w, lambda x, i: F.when(~is_anchor(x), i)), lambda i: i.isNotNull()))
    after = lambda k, d: F.coalesce(F.get(w, F.get(at, k + d)), F.lit(""))
    sigs = F.transform(at, lambda i, k: F.when(
        i - F.coalesce(F.get(at, k - 1), F.lit(-1)) > 1, F.xxhash64(F.get(w, i - 1), F.get(w, i), *[after(k, d) for d in range(1, CHAIN)])))
    df = df.withColumn(out, F.sort_array(F.array_distinct(F.filter(sigs, lambda s: s.isNotNull()))))
    df = df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(F.xxhash64(F.concat_ws(" ", F.col(w))))))
    return df.drop(w, at)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Jaccard of two signature arrays, 0 where they have nothing in common."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def text_form(sigs: str) -> Column:
    """The signatures as one string of 16-digit hexadecimal numbers."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def pairs(sigs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(a, b, near)``: rows of ``sigs`` (id, sigs) with likeness of ``threshold`` or more, a < b.

    Signature sets are partitioned by length so that two sets in partitions that are not the
    same or neighbours cannot be near enough. Within a partition (a set is also sent to the one
    below) candidates share one of the rarest signatures that any near set must share with them,
    and a pair is pruned by its lengths, and by where the shared signature stands in both sets,
    before its sets are compared. Equal sets are compared once; each set's rows are then
    linked to their smallest id, so a group of copies gives a star. Sets are never empty.
    """
    sets = sigs.groupBy("sigs").agg(F.min("id").alias("id"))
    sets = sets.withColumns({"n": F.size("sigs"), "part": F.floor(F.log(F.size("sigs").cast("double")) / F.lit(-1.0) / F.log(F.lit(float(threshold)))).cast("int")})
    sets = sets.withColumn("key", F.xxhash64("sigs"))
    spots = sets.select("id", "n", "part", F.explode("sigs").alias("s"))
    rarity = spots.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "s")
    placed = spots.join(rarity, "s").withColumn("at", F.row_number().over(order))
    head = placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    left = head.select("id", "n", "s", "at", "part")
    right = head.select("id", "n", "s", "at", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    x, y = left.alias("x"), right.alias("y")
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + F.least("x.at", "y.at")
    found = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") != F.col("y.id"))).where(
        (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold) & (most >= (F.col("x.n") + F.col("y.n")) * (threshold / (1 + threshold)) - 1e-9))
    found = found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    compared = found.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("sigs").alias("_b")), "b").select("a", "b", likeness("_a", "_b").alias("near")).where(F.col("near") >= threshold)
    copies = sigs.join(sets.select("sigs", F.col("id").alias("a")), "sigs").where("a < id").select("a", F.col("id").alias("b"), F.lit(1.0).alias("near"))
    return compared.unionByName(copies)


def _with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sigs`` of every row with ``next_text``, ``next_sigs`` of the next by id, the first after the last.

    Ids are cut into buckets; a bucket's first document is also sent to the bucket before it, so
    each row meets its successor in one window over its bucket after one shuffle of the texts.
    Buckets widen with the range of ids, so that there are at most BUCKETS, and the table of their
    first rows, which is broadcast, has a fixed bound. Ids in no order of insertion, with gaps or
    repeated, do no harm; null ids come first.
    """
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (0, 0) if low is None else (low, high)
    width = max(BUCKET_IDS, -(-(high - low + 1) // BUCKETS))
    ids = F.coalesce(F.expr(f"(doc_id - {low}L) div {width}L"), F.lit(-1).cast("long"))
    held = docs.select(ids.alias("_b")).distinct()
    everything = Window.orderBy("_b")  # a row per bucket
    chain = held.select("_b", F.coalesce(F.lag("_b").over(everything), F.max("_b").over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    firsts = docs.withColumn("_b", ids).groupBy("_b").agg(F.min("doc_id").alias("_first")).join(chain, "_b")
    rows = docs.select("doc_id", whole().alias("text")).withColumn("_b", ids).join(F.broadcast(firsts), "_b", "left")
    # Rows that may be the bucket's first are sent to the bucket before, behind all of its own.
    leads = F.col("doc_id").eqNullSafe(F.col("_first"))
    rows = rows.withColumn("_copy", F.explode(F.when(leads, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    rows = rows.select("doc_id", "text", F.when(F.col("_copy") == 1, F.col("_to")).otherwise(F.col("_b")).alias("_b"), "_copy").repartition("_b")
    rows = with_signatures(rows, "text", "sigs")
    order = Window.partitionBy("_b").orderBy("_copy", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(order), "next_sigs": F.lead("sigs").over(order)})
    return rows.where("_copy = 0").drop("_copy", "_b")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text) its fingerprint, that of its edited text, and how
    near it is to the edited text and to the next document.

    The edited text keeps the first half of the code points (the middle one included) and takes
    as many of the next document's first as it lost, or all. Null text is empty. A single row
    is its own next. Rows with the same id follow one another by text. Extra columns are ignored.
    """
    rows = _with_next(docs.select("doc_id", "text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text_form("sigs").alias("fingerprint"),
        text_form("edited_sigs").alias("edited_fingerprint"), likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"))

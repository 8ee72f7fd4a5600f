"""Quality rules: a table of thresholds compiled into one projection over counts of the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from planeweave.llm.common import WORD, whole, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is it for that was on are with as be at by this from or an a have has not "
    "der die das und in zu den von mit ist des im dem nicht ein eine als auch auf sich für "
    "le la les de et un une des en que qui dans est pour sur avec par au du il elle "
    "el los las del y en que es por con para su se no una un al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios; each bound is far from ordinary prose in the four languages.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.06, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def _counts(df: DataFrame) -> DataFrame:
    """The base counts and those that rules refer to, from the columns ``_t`` (text) and ``_w`` (words)."""
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        lines.alias("_l"),
        # Three-word windows by a 64-bit hash.
        F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))),
                    lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))).alias("_h"))
    # Only texts with a repeated window are sorted; equal neighbours in sorted order repeat.
    df = df.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")).alias("_s"))
    same = lambda x, k: F.coalesce(x.h == F.get("_s", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_s", k + 1).h, F.lit(False))
    places = F.sort_array(F.transform(F.filter("_s", same), lambda x: x.i))
    df = df.select("*", places.alias("_p"))
    covered = F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(3)), F.lit(3)))
    return df.select(
        "*", F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean expression."""
    passed = F.lit(True)
    for r in rules:
        n, d = F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            passed = passed & (n >= d * F.lit(r.low))
        if r.high is not None:
            passed = passed & (n <= d * F.lit(r.high))
    return passed


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs`` (doc_id, text).

    No shuffle and no Python: each text yields its row in one narrow stage. A null or empty
    text has zero counts and fails the base (fewer than 50 words). Repeated rows and null ids
    each keep their row; other columns of the input are ignored. ``n_repeat_words`` counts
    word places covered by a window of three words that occurs again in the same text.
    """
    t = docs.select("doc_id", whole().alias("_t"))
    t = t.select("*", words(F.col("_t")).alias("_w"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _counts(t).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
        "n_lines", "n_exclaims", "n_stop_words")


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
#: The same counts, rules spelt out, for DuckDB.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
c AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims,
             len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, w FROM w),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM d, range(3) k(k) GROUP BY r),
f AS (SELECT c.*, coalesce(p.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(p.n, 0) > 50 * n_words AS base_failed
      FROM c LEFT JOIN p USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars >= 2 * n_words AND word_chars <= 16 * n_words AND n_symbols <= 0.25 * n_words
       AND n_exclaims <= 0.25 * n_words AND n_stop_words >= 0.06 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept,
       n_lines, n_exclaims, n_stop_words
FROM f"""

"""The registered queries on text tables, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from planeweave.llm import jaccard, langid, linededup, lmscore, merkle, mixing, packing, pagetext, quality, spotsigs, toxicity, vectorcodes, warc
from planeweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


@query("op1_ngram_jaccard", jaccard.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


@query("op2_lm_scores", lmscore.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("log_score", "mean_log_score")}
    return lmscore.scores(table(spark, sf_dir, "documents")).withColumns(rounded)


@query("op3_line_dedup", linededup.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


@query("op4_quality_rules", quality.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_source_mix", mixing.SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op7_spot_signatures")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_page_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


@query("op11_warc", warc.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op12_vector_codes", vectorcodes.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.quantized(table(spark, sf_dir, "embeddings"))


@query("op13_merkle_manifest", merkle.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))

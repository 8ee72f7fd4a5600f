"""Each text query against its SQL on the smallest driver tables, and against brute force where SQL has no way."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_mod
from check_oracle import TABLES, compare
from planeweave.llm import queries, spotsigs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r[0], r[1] or "") for r in rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    message, _, _ = compare(spark, con, name, SF)
    assert message.startswith("ok"), message


def result(spark, name):
    return entry_mod.queries()[name](spark, SF).toPandas()


def test_spot_signatures_against_sets(spark, documents):
    anchors, texts = set(spotsigs.ANCHORS), list(documents.values())

    def signatures(t):
        w = [x for x in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if x]
        at = [i for i, x in enumerate(w) if x not in anchors]
        return {(w[i - 1], w[i], w[at[k + 1]] if k + 1 < len(at) else "") for k, i in enumerate(at) if i and w[i - 1] in anchors} or {tuple(w)}

    got = result(spark, "op7_spot_signatures").sort_values("doc_id")
    assert list(got.doc_id) == list(documents)
    for i, r in enumerate(got.itertuples()):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = signatures(text), signatures(edited), signatures(after)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))


def test_language_on_held_out_rows(spark):
    got = result(spark, "op8_language_id")
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert len(got) == len(truth) and (held.lang == held.lang_pred).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))


def test_packing_against_the_tokenizer(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = result(spark, "op9_packing")
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        ids = np.array(tokenizer.encode(documents[doc], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in pieces.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(ids[r.start:at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    for _, row in got.sort_values("offset").groupby("sequence_id"):
        assert list(row.offset) == list(np.cumsum([0, *row.length[:-1]])) and row.length.sum() <= 2048
    assert got.doc_id.nunique() == len(documents)
    assert got.length.sum() > 0.97 * 2048 * got.sequence_id.nunique()


def test_page_text_against_articles(spark):
    import html

    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = result(spark, "op10_page_text")
    for r in got.itertuples():
        article = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:p|h\d)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert len(got) == len(source)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = entry_mod.queries()["op5_toxicity"](spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").toPandas()
    held = got[got.held_out].merge(truth, on="doc_id")
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.5
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.06
    assert got.score.between(0, 1).all() and Counter(got.predicted == (got.score >= 0.5)) == {True: len(got)}

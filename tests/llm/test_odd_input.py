"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math

import pytest

import corpus_pipeline
from planeweave.llm import jaccard, langid, linededup, lmscore, mixing, packing, pagetext, quality, spotsigs, toxicity

OPERATORS = {
    "jaccard": lambda d, lab: jaccard.components(d), "lmscore": lambda d, lab: lmscore.scores(d), "linededup": lambda d, lab: linededup.digest(d),
    "quality": lambda d, lab: quality.quality(d), "toxicity": toxicity.predictions, "mixing": lambda d, lab: mixing.mix(d),
    "spotsigs": lambda d, lab: spotsigs.fingerprints(d), "langid": lambda d, lab: langid.predictions(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_every_row(odd_wide, labels, name):
    got = OPERATORS[name](odd_wide, labels).toPandas()
    assert len(got) == 18 and got.doc_id.isna().sum() == 1


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels.limit(0)).count() == 0


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_components_of_odd_rows(odd):
    got = by_id(jaccard.components(odd))
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12)] == [1, 2, 3, 4, 5, 1, 1, 1, 9, 9, 5]
    assert [got[i].n_shingles for i in (2, 3, 4, 9)] == [0, 0, 0, 1]
    assert got[None].component_id is None


def test_lines_of_odd_rows(odd):
    got = by_id(linededup.digest(odd))
    assert (got[2].n_lines, got[2].n_dropped, got[4].n_lines) == (1, 0, 3)
    assert got[6].n_dropped == got[8].n_dropped == 1 and got[1].n_dropped == 0
    assert got[15].n_dropped == 0 and got[16].n_dropped == 1  # an own repetition is no other document
    assert got[7].n_dropped == 0  # rows of one id are one document


def test_quality_of_odd_rows(odd):
    got = by_id(quality.quality(odd))
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[1].kept and not got[14].kept and got[15].n_dup_lines == 39
    assert got[15].n_repeat_words == got[15].n_words


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    for source in {r.source_size for r in rows}:
        own = [r for r in rows if r.source_size == source]
        # Whole blocks: a source of one part comes within a block of its target.
        assert abs(sum(r.taken for r in own) - sum({r.target for r in own})) <= mixing.BLOCK
    assert all(r.taken <= 2 * r.size for r in rows) and sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(5)).collect()))


def test_language_of_odd_rows(odd):
    got = by_id(langid.predictions(odd))
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[14].lang_pred == "und" and got[2].score == 0


def test_packing_of_odd_rows(odd_wide, empty):
    got = packing.pack(odd_wide).collect()
    assert sum(r.length for r in got if r.doc_id == 2) == 1 and len([r for r in got if r.doc_id == 7 and r.start == 0]) == 2
    places = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 2048 and packing.pack(empty).count() == 0


def test_scores_of_odd_rows(odd):
    got = by_id(lmscore.scores(odd))
    assert got[2].log_score == 0 and got[2].mean_log_score is None and math.isfinite(got[5].log_score)


def test_pages(spark):
    schema = "page_id long, url string, html string, key string"
    page = "<nav><a>Home</a></nav><div>Site name</div><div><p>{}</p><p>{}</p></div><div>All rights reserved</div>"
    rows = [
        (1, "http://h/a/1", page.format("First &amp; only paragraph of a page that has a fair number of words", "one"), "x"), (2, "http://h/a/2", page.format("Second   text\n here which goes on for about as long as the other one does", "two"), "x"), (2, "http://h/a/2", page.format("Second   text\n here which goes on for about as long as the other one does", "two"), "x"),
        (3, None, None, None), (4, "http://h/a/3", "", "x"), (None, "http://other/", "<article><h1>T</h1><p>a<br>b<div class='comments'><p>me too</p></div></article>", None),
        (5, "http://c/1", "<main><p>Copied body text of some length</p></main>", "x"), (6, "http://c/2", "<main><p>Copied body text of some length</p></main>", "x"),
    ]
    got = {}
    for r in pagetext.extract(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == ["First & only paragraph of a page that has a fair number of words\n\none"] and got[2] == ["Second text here which goes on for about as long as the other one does\n\ntwo"] * 2
    assert got[3] == got[4] == [""] and got[None] == ["T\n\na b"]
    assert got[5] == got[6] == ["Copied body text of some length"]  # a copy of a page is no evidence of furniture
    assert pagetext.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("page", [
    "<body class='single no-sidebar'><article><p>Own text</p></article></body>",
    "<body id=widget><div>Own text</div></body>",
    "<div class='content has-sidebar'><p>Own text</p></div>",
    "<div class='sidebar'><article><p>Own text</p></article></div><p>else</p>",
    "<article class='post comments-open'><p>Own text</p></article>",
    "<main class='notice'><p>Own text</p></main>",
    "<form action='/'><nav>Menu</nav><main><p>Own text</p></main></form>",
    "<body><form id=aspnetForm><nav>Menu</nav><div><p>Own text</p></div></form></body>",
    "<head><title>Title</title><body><p>Own text</p></body>",
    "<head><meta charset=utf-8><title>Title</title><p>Own text</p>",
    "<head><title>Title</title><article>Own text</article>",
    "<article><p>Own text</p></article><section id=comments><article><p>Me too</p></article></section><form>Search</form>",
])
def test_markup_keeps_articles(page):
    found = pagetext.lines(page)
    article = pagetext.ARTICLE in [r for _, r in found]
    assert [t for t, r in found if r == (pagetext.ARTICLE if article else pagetext.BODY)] == ["Own text"]


def test_shared_lines_in_articles(spark):
    def page(tag, own):
        return f"<nav>Home</nav><{tag}><div>A long notice on all the pages of this site, with more text than they have themselves</div><p>{own}</p></{tag}>"

    texts = {i: f"Own text {i}" for i in range(40)}
    rows = [(i, f"http://h{i % 2}/{i // 2:02}", page("article" if i % 2 else "main", t)) for i, t in texts.items()]
    # Copies beside each other, more than a partition holds, and the last but one page of a host.
    rows += [(100 + i, f"http://h0/05/{i:02}", page("main", "Copied text that stands on a run of pages")) for i in range(30)]
    rows += [(200 + i, f"http://h1/99/{i}", page("article", "Copied text at the end")) for i in range(2)]
    # Two nearly equal pages beside unlike ones.
    near = ["A paragraph that two pages have", "Another paragraph that both of them have too"]
    rows += [(300 + i, f"http://n/{i}", f"<main><p>Notice</p>{''.join(f'<p>{t}</p>' for t in own)}</main>") for i, own in enumerate([["First page here"], [*near, "one"], [*near, "two"], ["Last page here"]])]
    want = texts | {100 + i: "Copied text that stands on a run of pages" for i in range(30)} | {200 + i: "Copied text at the end" for i in range(2)}
    want |= {300: "First page here", 301: "\n\n".join([*near, "one"]), 302: "\n\n".join([*near, "two"]), 303: "Last page here"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in pagetext.extract(pages).collect()} == want


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, tmp_path, odd_wide, empty, labels, k):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    got = stage(spark, odd_wide, str(tmp_path))
    assert got.count() > 0 and stage(spark, empty, str(tmp_path)).count() == 0
    if k < 4:
        assert got.columns == odd_wide.columns


def test_stage_results(spark, odd, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    lines = corpus_pipeline.STAGES[1][1](spark, odd, str(tmp_path)).collect()
    assert len(lines) == 18 and {r.doc_id: r.text for r in lines}[6] == "" and [r.text for r in lines if r.doc_id == 2] == [None]
    kept = sorted(str(r.doc_id) for r in corpus_pipeline.STAGES[2][1](spark, odd, str(tmp_path)).collect())
    assert kept == sorted(map(str, [1, 2, 3, 4, 5, 9, 11, 13, 14, 15, 16, None]))
    mixed = corpus_pipeline.STAGES[3][1](spark, odd, str(tmp_path)).collect()
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    taken = {}
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in taken.items() if v}

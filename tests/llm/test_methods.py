"""The methods themselves: filters, plans, sequences, fields and estimators on small cases with known answers."""

import random
from collections import defaultdict
from itertools import count

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from planeweave.llm import jaccard, langid, linededup, mixing, packing, pagetext, spotsigs, toxicity

from .conftest import prose


def test_cuckoo_filter_takes_back_what_it_took():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    held = linededup.CuckooFilter.of(keys[:15_000])
    before = np.sort(held.cells, axis=None)
    assert held.contains(keys[:15_000]).all() and held.contains(keys[15_000:]).mean() < 0.01
    assert held.insert(keys[15_000:15_500])
    held.delete(keys[15_000:15_500])
    assert held.contains(keys[:15_000]).all() and (np.sort(held.cells, axis=None) == before).all()


def test_line_index_is_reversible(spark):
    rows = [(i, "\n".join(["a shared line of text", f"own line number {i} here"] + (["a line of two documents"] if i in (2, 5) else [])), i) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    first, second = docs.where("doc_id <= 4"), docs.where("doc_id > 4")
    state = lambda x: sorted((bytes(r.key), r.n_docs, r.first_doc) for r in x.shared.collect())
    held = lambda x: sorted((r.shard, bytes(r.cells)) for r in x.filters.collect())
    start = linededup.LineIndex.build(first)
    grown = start.insert(second)
    assert state(grown) == state(linededup.LineIndex.build(docs)) and len(state(grown)) == 2
    back = grown.delete(second.select("doc_id"))
    assert state(back) == state(start) and held(back) == held(start)
    moved = grown.delete(first.where("doc_id = 1").select("doc_id"))
    assert min(r[2] for r in state(moved)) == 2
    cleaned = {r.doc_id: r.__getitem__("__text") for r in linededup.clean(docs.where("doc_id <> 1"), moved).collect()}
    assert "shared line" in cleaned[2] and "shared line" not in cleaned[3]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 500), max_size=12))
def test_patterns_cover_the_demand(demand):
    plan = packing.patterns(demand, 128)
    made: dict[int, int] = {}
    for use, copies in plan:
        assert sum(k * n for k, n in use.items()) <= 128
        for k, n in use.items():
            made[k] = made.get(k, 0) + n * copies
    assert made == demand
    least = -(-sum(k * n for k, n in demand.items()) // 128)
    if all(k <= 64 for k in demand):
        assert sum(c for _, c in plan) <= 2 * least + 1


def test_patterns_reach_the_optimum():
    assert sum(c for _, c in packing.patterns({70: 30, 58: 30, 40: 60, 24: 60, 64: 10}, 128)) == 30 + 30 + 5


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 'sé\n\t .1²…<|>日 \x0b"), max_size=40))
def test_token_bytes_are_the_tokenizers(text):
    tokens = packing._token_bytes(None)
    ids = tokens.tokenizer.encode(text, add_special_tokens=False).ids
    assert tokens.of(text) == np.array(ids, "<u4").tobytes()


def test_shards_and_targets_of_the_mix(spark):
    rows = [(i, prose(i, 30 + i % 50), s) for i, s in enumerate("aaaaaabbbc" * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=16, shard=500).toPandas()
    docs_by = {r[0]: r[2] for r in rows}
    got["source"] = [docs_by[i] for i in got.doc_id]
    total = got["size"].sum()
    sizes, target, taken = (got.groupby("source")[c].agg("sum" if c != "target" else "first") for c in ("size", "target", "taken"))
    assert target.sum() == pytest.approx(1.5 * total) and (target <= 2 * sizes + 1e-6).all()
    assert (abs(taken - target) < 0.01 * target + 60).all() and (got.taken <= 2 * got["size"]).all()


def test_seats_are_those_of_highest_quotients(spark):
    """Against handing out one seat after the other."""
    dice, block = random.Random(3), 10
    cells = []
    for shard in range(6):
        for src in range(dice.randrange(1, 9)):
            words = dice.choice([0, 3, 10, 95, 400])
            cells.append((shard, f"s{src}", shard, words, words * dice.choice([0.0, 0.5, 1.25, 2.0])))
    got = {(r._src, r._part): r.seats for r in mixing.seats(spark.createDataFrame(cells, "_shard int, _src string, _part int, words long, votes double"), block).collect()}
    for shard in range(6):
        own = {c[1]: c for c in cells if c[0] == shard}
        won = dict.fromkeys(own, 0)
        for _ in range(int(sum(int(c[4] + 0.5) for c in own.values()) / block + 0.5)):
            open_ = [s for s in own if won[s] < (2 * max(1, (2 * own[s][3] + block) // (2 * block)) if own[s][3] else 0)]
            best = min(open_, key=lambda s: (-own[s][4] / (2 * won[s] + 1), s))
            won[best] += 1
        assert {s: got.get((s, shard), 0) for s in own} == won


def test_what_is_taken_follows_the_seats(spark):
    """Every part gives whole blocks, as many as its seats, and none a third time."""
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = mixing._taken(mixing._sizes(docs, F.lit(0).cast("long")), mixing.WEIGHTS, 1.5, 2.0, 16, 700, "x").toPandas()
    per_block = pieces.groupby(["_src", "_part", "_block"])[["_n", "_once", "_twice"]].sum().reset_index()
    assert ((per_block._once == 0) | (per_block._once == per_block._n)).all() and ((per_block._twice == 0) | (per_block._twice == per_block._n)).all()
    for (src, part), b in per_block[per_block._n > 0].groupby(["_src", "_part"]):
        mine = pieces[(pieces._src == src) & (pieces._part == part)]
        given = (b._once > 0).sum() + (b._twice > 0).sum()
        assert given == mine.seats.fillna(0).iloc[0] and ((b._twice > 0) <= (b._once > 0)).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_lines_are_a_longest_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    kept = pagetext.common(np.array(a, int), np.array(b, int))
    assert kept.sum() == table[-1][-1]
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in np.array(a, int)[kept])


def test_forward_backward_against_all_paths():
    from itertools import product

    dice = np.random.default_rng(5)
    emit, step, start = dice.normal(size=(4, 2, 3)), dice.normal(size=(3, 3)), dice.normal(size=3)
    size = np.array([4, 2])
    marginals, pairs = langid.forward_backward(emit, size, step, start)
    want, want_pairs = np.zeros_like(marginals), np.zeros((3, 3))
    for b in range(2):
        weights = {p: np.exp(start[p[0]] + sum(emit[i, b, k] for i, k in enumerate(p)) + sum(step[x, y] for x, y in zip(p, p[1:]))) for p in product(range(3), repeat=size[b])}
        z = sum(weights.values())
        for p, w in weights.items():
            for i, k in enumerate(p):
                want[i, b, k] += w / z
            for x, y in zip(p, p[1:]):
                want_pairs[x, y] += w / z
    assert np.allclose(marginals, want) and np.allclose(pairs, want_pairs)


def test_field_labels_words_of_a_mixed_text():
    en, de = "the walker talked gently with others near the harbour", "der wanderer sprach leise mit anderen nahe dem hafen"
    model = langid.fit([("en", (en + " ").encode().split() * 12), ("de", (de + " ").encode().split() * 12)] * 6, ["de", "en"], rounds=4)
    words = b"the harbour talked gently der wanderer sprach leise".split()
    marginals, _ = langid.forward_backward(model.emissions(words).astype(float)[:, None, :], np.array([8]), model.step, model.start)
    assert list(marginals[:, 0].argmax(1)) == [1] * 4 + [0] * 4


def test_field_reads_long_words_whole():
    en, de = "thewalkertalkedgentlywithothersneartheharbour", "derwanderersprachleisemitanderennahedemhafen"
    model = langid.fit([("en", langid.labels(" ".join([en[i:], *en[i:i + 9].split()]).encode()) * 12) for i in range(8)] + [
        ("de", langid.labels(" ".join([de[i:], *de[i:i + 9].split()]).encode()) * 12) for i in range(8)], ["de", "en"], rounds=4)
    texts = [b"0" * 60 + middle.encode() + b"0" * 60 for middle in (de, en)]
    mean, _ = langid._batch(model, texts, defaultdict(count().__next__), [])
    assert list(mean.argmax(1)) == [0, 1]
    for text in (de.encode() * n + b"x" * k for n in (1, 3) for k in range(25)):
        pieces = [p.strip(langid.OPEN) for p in langid.labels(text)]
        assert pieces[0] + b"".join(p[2:] for p in pieces[1:]) == text and max(map(len, pieces)) <= langid.PIECE


def test_positive_unlabelled_learning_finds_the_toxic_among_unlabelled():
    dice = np.random.default_rng(2)
    toxic = dice.random(1200) < 0.1
    positive = np.r_[np.ones(200, bool), np.zeros(1200, bool)]
    bad = np.r_[np.ones(200, bool), toxic]
    rows, cols = [], []
    for i, b in enumerate(bad):
        own = set(dice.integers(5, 30, 4)) | ({int(dice.integers(0, 5))} if b else set())
        rows += [i] * len(own)
        cols += own
    weights, bias = toxicity.fit(np.array(rows), np.array(cols), positive, 30, 0.1)
    g = np.bincount(rows, weights[np.array(cols)], len(bad)) + bias
    assert (g[200:][toxic] > 0).mean() > 0.95 and (g[200:][~toxic] > 0).mean() < 0.05


def test_jaccard_shingles_of_one_list_meet_once(spark):
    """Sets that share hundreds of prefix shingles meet once for each list of sets, not once for each shingle."""
    common, other = [f"c{i}" for i in range(600)], [f"o{i}" for i in range(300)]
    texts = [common + [f"a{i}" for i in range(60)], common + [f"b{i}" for i in range(60)], common[:400] + other, other + [f"d{i}" for i in range(900)]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*texts, texts[0]])], "doc_id long, text string").repartition(3)
    sketch = np.zeros(jaccard.CELLS, np.int64)
    sets = [jaccard.shingles(" ".join(w).encode(), jaccard._Words()) for w in texts]
    for s in sets:
        np.add.at(sketch, jaccard._cell(s), 1)
    rank = np.minimum(255, 8 * np.log2(1.0 + sketch)).astype(np.uint8)
    heads = [s[np.argsort(rank[jaccard._cell(s)], kind="stable")[:jaccard._prefix(len(s), 75)]].tolist() for s in sets]
    want = {}
    for t in set(sum(heads, [])):
        held = frozenset(k for k, h in enumerate(heads) if t in h)
        if len(held) > 1:
            first, times = want.get(held, ({}, 0))
            want[held] = ({k: min(first.get(k, 1 << 30), heads[k].index(t)) for k in held}, times + 1)
    assert max(times for _, times in want.values()) > 50
    called = {jaccard.name(s): k for k, s in enumerate(sets)}
    got = {}
    for r in jaccard._lists(docs, sketch, 1, 5, 75).collect():
        got.setdefault(r["list"], []).append((called[bytes(r["set"])], r["pos"], r["times"]))
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted((k, p, times) for k, p in first.items()) for first, times in want.values())
    assert {r.doc_id: r.component_id for r in jaccard.components(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0}



def test_jaccard_bitmaps_never_rule_out_a_link():
    """Parity bitmaps bound the distance from below, also over two bitmap sizes, and tell loose pairs apart."""
    rng = np.random.default_rng(7)
    for n in (1, 3, 40, 63, 66, 900, 1030, 70_000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for kept, extra in ((len(a), 0), (len(a), len(a) // 4), (len(a) * 9 // 10, len(a) // 20), (len(a) // 2, len(a) // 2), (0, len(a))):
            b = np.union1d(a[:kept], rng.integers(0, 1 << 63, extra, dtype=np.uint64))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            true = 1 - both / (len(a) + len(b) - both)
            low = jaccard._least_distance(len(a), jaccard.parities(a), len(b), jaccard.parities(b))
            assert low <= true + 1e-12
            assert low > 0.25 or true < 0.5 or n < 40


def test_jaccard_loose_group_meets_in_few_pairs(spark, monkeypatch):
    """Texts that share a passage too short to link them: few pairs of them ask for their texts."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(48)]
    docs = spark.createDataFrame([(k, " ".join([f"w{x}" for x in rng.integers(0, 10**9, 6)] + passage + [f"w{x}" for x in rng.integers(0, 10**9, 6)]))
                                  for k in range(60)], "doc_id long, text string")
    asked, compare = [], jaccard.compare

    def watched(pairs, *rest):
        asked.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(jaccard, "compare", watched)
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    assert got == {k: k for k in range(60)} and sum(asked) <= 10


def test_jaccard_groups_larger_than_a_part_and_chains(spark):
    dice = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows, n = [], 0
    for i in range(400):  # one group of near copies, each with its own change
        w = list(base)
        w[dice.randrange(120)] = f"x{i}"
        rows.append((n, " ".join(w)))
        n += 1
    chain = [f"c{i}" for i in range(200)]  # each links to the next only
    for i in range(8):
        rows.append((n, " ".join(chain[i * 10:i * 10 + 100])))
        n += 1
    for i in range(60):  # a passage in many documents that are otherwise different
        rows.append((n, " ".join(base[:60] + [f"p{i}.{k}" for k in range(60)])))
        n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.components(docs).collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in sets}


def test_spot_signature_pairs(spark):
    rows = [(i, prose(i // 3, 150) + (" tail" if i % 3 == 1 else "")) for i in range(30)]
    docs = spotsigs.with_signatures(spark.createDataFrame(rows, "id long, text string"), "text", "sigs").select("id", "sigs")
    sigs = {r.id: set(r.sigs) for r in docs.collect()}
    near = {(a, b) for a in sigs for b in sigs if a < b and len(sigs[a] & sigs[b]) >= 0.75 * len(sigs[a] | sigs[b])}
    got = {(r.a, r.b) for r in spotsigs.pairs(docs).collect()}
    root = lambda pairs: {x: min([x] + [a for a, b in pairs if b == x] + [b for a, b in pairs if a == x]) for x in sigs}
    assert got <= near and root(got) == root(near)

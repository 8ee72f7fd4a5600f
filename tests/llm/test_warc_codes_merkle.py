"""WARC transactions, vector codes and Merkle proofs against brute force, odd input included."""

import hashlib
import math
import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planeweave.llm import merkle, vectorcodes, warc
from planeweave.llm.common import shared_folder
from tests.llm.conftest import CLASHES, odd_rows


def wide(df):
    return df.select("*", *[F.lit("x").alias(c) for c in (*CLASHES, "record_id", "kind", "first", "digest", "payload", "tree", "pos", "leaf", "h", "x", "code") if c not in df.columns])


# WARC

LONG = "<p>" + "long body " * 200 + "</p>"
PAGES = [
    (1, "https://a.example/x?y=1#z", LONG), (2, "https://b.example", LONG), (9, "https://c.example/", LONG), (3, None, "short"), (4, "https://a.example/s", "short"),
    (5, "https://a.example/null", None), (6, "https://a.example/empty", ""), (7, "bad url\r\nX: y\x00", "<p>ünï \U0001F600 \x00</p>"),
    (8, "https://a.example/trap", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (8, "https://a.example/trap", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
    (None, "https://n.example/", LONG), (None, None, "only null " * 150), (10, "https://t.example/1", "tie " * 300), (10, "https://t.example/2", "tie " * 300), (2, "https://t.example/3", "tie " * 300),
    (11, "https://v.example/", "very long \n" * 300_000), (12, "https://w.example/", "very long \n" * 300_000),
]


def expected_warc(rows):
    top = {}
    for i, _, html in rows:
        b = (html or "").encode()
        top[b] = max(top.get(b, -1), -1 if i is None else i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = len(b) < warc.REVISIT_BYTES or (-1 if i is None else i) == top[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else top[b]))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("per_file", [1, 4, 1000])
def test_round_trip_equals_the_rule(spark, per_file):
    got = warc.round_trip(wide(pages(spark, PAGES)), per_file)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_warc(PAGES)


def test_many_copies_and_empty_table(spark):
    rows = [(i, f"https://h{i % 3}.example/{i}", LONG) for i in range(400)]
    assert sorted(map(tuple, warc.round_trip(pages(spark, rows)).collect()), key=repr) == expected_warc(rows)
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_files_are_warc_and_captures_nest_three_records(spark):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = [r for r in PAGES if r[0] not in (None, 8)]
    warc.write_archives(pages(spark, rows), path, 3)
    files = spark.read.format("binaryFile").load(path).where("path like '%part-%'").collect()
    text = [zlib.decompress(bytes(f.content), 47) for f in files]
    assert all(t.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and t.endswith(b"\r\n\r\n") for t in text) and len(files) > 3
    assert sum(t.count(b"\r\nWARC-Refers-To: ") for t in text) == len([r for r in expected_warc(rows) if r[3] == "revisit"])
    found = warc.read_archives(spark, path)
    assert {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}["metadata"] == len(rows)
    whole = warc.assemble(found).withColumn("page_id", warc.page_id_of(F.col("metadata.fields"))).collect()
    back = sorted(((r.page_id, bytes(r.payload).decode()) for r in whole), key=repr)
    assert back == sorted(((i, h or "") for i, _, h in rows), key=repr)  # revisits too have the payload
    one = next(r for r in whole if r.page_id == 1)
    assert one.request.http.startswith("GET /x?y=1 HTTP/1.1\r\nHost: a.example") and one.response.http.startswith("HTTP/1.1 200 OK") and one.uri == "https://a.example/x?y=1#z"
    odd = next(r for r in whole if r.page_id == 7)
    assert odd.uri == "bad url%0D%0AX: y%00"


def test_captures_without_partners(spark):
    rows = [("response", "<r1>", None, None, b"abc"), ("request", "<q9>", "<r9>", None, None), ("revisit", "<r2>", None, "<r7>", None), ("request", "<q1b>", "<r1>", None, None), ("request", "<q1a>", "<r1>", None, None)]
    df = spark.createDataFrame(rows, "kind string, record_id string, concurrent_to string, refers_to string, payload binary").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("uri", "date", "declared_digest", "http", "fields")])
    got = {r.capture_id: r for r in warc.assemble(df).collect()}
    assert set(got) == {"<r1>", "<r2>"} and got["<r1>"].request.record_id == "<q1a>" and got["<r1>"].metadata is None
    assert got["<r2>"].payload is None and got["<r2>"].response.refers_to == "<r7>"


def test_plain_archive_of_several_members():
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    for content in (one * 3, _gz(one) * 3):
        assert [(r[0], r[1], r[8]) for r in warc._walk(content)] == [("metadata", "<a>", "a: b")] * 3
    with pytest.raises(ValueError):
        list(warc._walk(one[:-6]))


def _gz(b):
    z = zlib.compressobj(wbits=31)
    return z.compress(b) + z.flush()


# Vector codes

def nearest(x, book):
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("seed", range(6))
def test_orchard_finds_the_first_nearest_entry(seed):
    dice = np.random.default_rng(seed)
    k, w, span = int(dice.integers(1, 40)), int(dice.integers(1, 9)), int(dice.choice([2, 5, 1000]))
    book, x = dice.integers(-span, span, (k, w)), dice.integers(-span, span, (500, w))  # small spans: many ties and equal entries
    for a, b in zip(vectorcodes.orchard(x, book), nearest(x, book)):
        assert (a == b).all()


def test_orchard_leaves_far_entries_out():
    """Of a hundred groups far apart, a walk measures its own group and few others."""
    dice = np.random.default_rng(3)
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.ndim == 1:
                seen.append(len(key))
            return np.asarray(super().__getitem__(key))

    book = (np.arange(128) // 8 * 100_000 + dice.integers(0, 100, 128)).reshape(-1, 1)
    x = dice.integers(0, 100, (200, 1))  # all of them in the first group
    got, _ = vectorcodes.orchard(x, book.view(Counting), vectorcodes.neighbour_lists(book))
    assert (got == nearest(x, book)[0]).all() and sum(seen) < 200 * 10


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    scaled = [(i, [math.floor(max(-32768.0, min(32768.0, c)) * 4096) for c in v], lab) for i, v, lab in kept]
    scaled.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(scaled[0][1])
    scaled = [r for r in scaled if len(r[1]) == dims]
    if dims % parts:
        return []
    w = dims // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    books = [[cut(r[1], p) for r in scaled[:entries]] for p in range(parts)]

    def near(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in scaled:
                groups.setdefault(near(v, p)[0], []).append(cut(v, p))
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, lab in scaled:
        found = [near(v, p) for p in range(parts)]
        err = sum(d for _, d in found)
        total[lab] = total.get(lab, 0) + err
        out.append([i, "".join(f"{k:02x}" for k, _ in found), err, lab])
    return sorted([(i, c, e, total[lab], sha) for i, c, e, lab in out], key=repr)


def vectors(n, dims=16, seed=1):
    dice = random.Random(seed)
    return [(i * 3, [float(np.float32(dice.gauss(i % 5, 0.3))) for _ in range(dims)], dice.choice([1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "odd", "few", "uneven", "none"])
def test_codes_equal_brute_force(spark, case):
    rows = {"plain": vectors(120), "few": vectors(5), "uneven": vectors(30, dims=12), "none": [(1, None, 1), (2, [], 2), (3, [float("nan")] * 16, 2)]}.get(case)
    if case == "odd":
        nan, inf = float("nan"), float("inf")
        rows = vectors(60) + [(7, None, 1), (8, [], 1), (None, [0.5] * 16, 2), (None, [-0.5] * 16, 2), (9, [0.1] * 8 + [None] + [0.1] * 7, 1), (10, [nan] * 16, 1), (11, [inf] + [0.0] * 15, 1), (12, [-inf] + [0.0] * 15, None),
                              (13, [1e30, -1e30] * 8, 1), (14, [0.25] * 15, 1), (14, [0.25] * 17, 1), (3, [0.1] * 16, 1), (3, [0.1] * 16, 1), (15, [-0.00001] * 16, None)] + [(100 + i, [0.75] * 16, 3) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(map(tuple, vectorcodes.quantized(wide(df)).collect()), key=repr)
    exact = [(i, v and [c if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    assert got == brute_codes(exact)


# Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_merkle(rows):
    """Proofs by walking every level from every leaf."""
    trees = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(*(enc(v) for v in (doc_id, source, lang, n, text)))
        bad = None
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            bad = h(*(enc(v) for v in (doc_id, source, lang, n, low)))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, bad, doc_id))

    def climb(nodes):
        """Each node's (left, right) siblings up to the single one that remains, and its digest."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 8 * 8:p // 8 * 8 + 8]
                paths[i].append(("".join(run[:p % 8]), "".join(run[p % 8 + 1:])))
                at[i] = p // 8
            nodes = [h(*nodes[a:a + 8]) for a in range(0, len(nodes), 8)]
        return paths, nodes[0]

    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    done = {}
    for lang in order:
        own = sorted(trees[lang], key=lambda r: r[:3])
        done[lang] = (own, *climb([r[2] for r in own]))
    tops, root = climb([done[k][2] for k in order])
    out = []
    for lang, top in zip(order, tops):
        own, paths, subroot = done[lang]
        for (_, _, leaf, bad, doc_id), path in zip(own, paths):
            f = bad or leaf
            for left, right in path + top:
                f = h(left, f, right)
            out.append((doc_id, leaf, subroot, root, h(*(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("case", ["odd", "one", "one_lang", "exact_powers", "many_langs", "repeated"])
def test_manifest_equals_brute_force(spark, case):
    plain = lambda n, lang: [(i, f"Text {i} IN {lang}", lang, "s", i) for i in range(n)]
    rows = {"odd": odd_rows(), "one": plain(1, "en"), "one_lang": plain(100, "en"), "exact_powers": plain(512, "en") + plain(64, "de") + plain(8, "fr") + plain(9, "es") + plain(1, None) + plain(65, ""),
            "many_langs": [(i, "X", f"l{i % 70}", None, None) for i in range(300)] + plain(600, "en"), "repeated": [(5, "SAME", "en", "s", 4)] * 300 + plain(30, "en")}[case]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, merkle.verified(wide(df)).collect()), key=repr)
    assert got == brute_merkle(rows)
    assert case in ("odd", "one", "repeated") or {r[-1] for r in got} == {True, False}


def test_manifest_of_nothing(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).count() == 0

"""Stupid-backoff language model scores from n-gram counts partitioned by hash.

Documents are read once into coded batches: the distinct words of a batch by 128-bit hash, and
each text as numbers of them. Every batch counts its own distinct n-grams, sends each with its
count to the partition of its hash, and there all batches' counts of an n-gram are summed. The
sums go back to the batches that asked, where they are joined to the n-grams of each text and
the scores summed per document. So a frequent n-gram is one row per batch, not per occurrence.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from planeweave.llm.common import stored, whole

ORDER = 2
BACKOFF = 0.4
#: Words of a batch, at least, before it is closed; the longest text may exceed it.
BATCH_WORDS = 2_000_000
#: Distinct n-grams of a partition of the count tables, about.
GRAMS_PER_BUCKET = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _press(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b"".join(a.tobytes() for a in arrays))


def _undo(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _coded(docs: DataFrame, batch_words: int) -> DataFrame:
    """``(batch, ids, sizes, vocabulary, codes)``, one row per batch."""
    def close(ids, texts, numbers):
        codes = np.concatenate(texts) if texts else np.zeros(0, np.uint32)
        vocabulary = np.frombuffer(b"".join(xxhash.xxh3_64_digest(w) for w in numbers), ">u8").astype(np.uint64)
        return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                                pa.array([_press(vocabulary)], pa.binary()), pa.array([_press(codes)], pa.binary())], ["batch", "ids", "sizes", "vocabulary", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, numbers, n = [], [], {}, 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = [numbers.setdefault(w, len(numbers)) for w in text.lower().split()]
                ids.append(doc)
                texts.append(np.array(own, np.uint32))
                n += len(own)
                if n >= batch_words:
                    yield close(ids, texts, numbers)
                    ids, texts, numbers, n = [], [], {}, 0
        if ids:
            yield close(ids, texts, numbers)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return stored(rows.mapInArrow(run, "batch string, ids array<long>, sizes array<long>, vocabulary binary, codes binary"))


def _grams(vocabulary: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of one order, and for each word place whether one ends there.

    An n-gram does not cross from one text into the next.
    """
    words = vocabulary[codes]
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.arange(len(codes)) - start >= order - 1
    at = np.flatnonzero(ends)
    g = np.full(len(at), order, np.uint64)
    for k in range(order - 1, -1, -1):
        g = (g * _STEP) ^ words[at - k]
        g *= _MIX
        g ^= g >> np.uint64(29)
    return g, ends


def _batch_grams(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vocabulary = np.frombuffer(_undo(row["vocabulary"]), np.uint64)
    codes = np.frombuffer(_undo(row["codes"]), np.uint32)
    sizes = np.array(row["sizes"], np.int64)
    return *_grams(vocabulary, codes, sizes, order), sizes


def _counts(coded: DataFrame, order: int, buckets: int) -> DataFrame:
    """``(batch, order, bucket, counts)``: for each batch the corpus counts of its distinct n-grams, in the
    order of their hashes within a bucket of the hash space."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g, n = np.unique(_batch_grams(row, order)[0], return_counts=True)
                cut = np.append(np.searchsorted(g, _bounds(buckets)), len(g))
                parts = [(b, _press(g[i:j], n[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
                yield pa.record_batch([pa.array([row["batch"]] * len(parts), pa.string()), pa.array([b for b, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())],
                                      ["batch", "bucket", "part"])

    def answer(key, rows):
        names, grams, counts = rows.column("batch").to_pylist(), [], []
        for part in rows.column("part").to_pylist():
            raw = _undo(part)
            k = len(raw) // 12
            grams.append(np.frombuffer(raw, np.uint64, k))
            counts.append(np.frombuffer(raw, np.uint32, k, 8 * k))
        every, where = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts).astype(np.float64), len(every)).astype(np.uint64)
        own = np.split(total[where], np.cumsum([len(g) for g in grams])[:-1])
        return pa.table({"batch": pa.array(names, pa.string()), "order": pa.array([order] * len(names), pa.int32()),
                         "bucket": pa.array([key[0].as_py()] * len(names), pa.int32()), "counts": pa.array([_press(c) for c in own], pa.binary())})

    return coded.mapInArrow(ask, "batch string, bucket int, part binary").groupBy("bucket").applyInArrow(answer, "batch string, order int, bucket int, counts binary")


def _bounds(buckets: int) -> np.ndarray:
    """Where the hash space is cut: bucket b begins at bound b."""
    return np.array([i * ((1 << 64) // buckets) for i in range(buckets)], np.uint64)


def _score(order: int, backoff: float, words: int):
    """Scores of the texts of a batch from the counts of all orders.

    Leave-one-out: a document's own occurrences are taken off every count, and its length off the corpus.
    """
    def run(key, left, right):
        row = left.to_pylist()[0]
        answers: dict[int, list] = {}
        for k, b, c in zip(*(right.column(x).to_pylist() for x in ("order", "bucket", "counts"))):
            answers.setdefault(k, []).append((b, np.frombuffer(_undo(c), np.uint64)))
        sizes = np.array(row["sizes"], np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        others = np.maximum(words - sizes, 1)[doc].astype(float)
        held: dict[int, np.ndarray] = {}
        for k in range(1, order + 1):
            g, ends, _ = _batch_grams(row, k)
            held[k] = np.zeros(len(doc))
            if not len(g):
                continue
            every, where = np.unique(g, return_inverse=True)
            total = np.concatenate([c for _, c in sorted(answers[k], key=lambda x: x[0])]).astype(float)
            pair, inverse, own = np.unique(doc[ends] * np.int64(len(every)) + where, return_inverse=True, return_counts=True)
            held[k][ends] = total[where] - own[inverse]
        # From the shortest n-gram to the longest, the last that the other documents hold decides.
        seen = held[1] > 0
        p = np.log(np.where(seen, held[1], 0.5) / others) + 0.0
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for k in range(2, order + 1):
            context = np.r_[0.0, held[k - 1][:-1]] if len(doc) else held[k - 1]
            found = (held[k] > 0) & (place >= k - 1)
            p = np.where(found, np.log(np.where(found, held[k], 1) / np.where(found, np.maximum(context, 1), 1)), np.where(place >= k - 1, math.log(backoff) + p, p))
        total = np.bincount(doc, p, len(sizes))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(sizes), "log_score": pa.array(total),
                         "mean_log_score": pa.array([t / n if n else None for t, n in zip(total, sizes)], pa.float64())})

    return run


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF,
           batch_words: int = BATCH_WORDS, grams_per_bucket: int = GRAMS_PER_BUCKET) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` for every row of ``docs`` (doc_id, text).

    Words are the blank-separated runs of the text, A-Z in lower case. The score of a word is
    count(n-gram) / count(context) for the longest n-gram up to ``order`` that other documents
    hold, times ``backoff`` for each order given up; at last count(word) / words of the other
    documents, a word of no other document counting one half. All counts cover the whole table less
    the document itself, so no text is its own evidence. log_score is the sum of natural logarithms.

    Null or empty text has no words, log_score 0 and a null mean. Repeated rows are documents of
    their own and evidence for each other. Hashes are of 64 bits.
    """
    coded = _coded(docs, batch_words)
    words = coded.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    answers = None
    for k in range(1, order + 1):
        buckets = max(1, math.ceil(words * (0.7 if k > 1 else 0.1) / grams_per_bucket))
        own = _counts(coded, k, buckets)
        answers = own if answers is None else answers.unionByName(own)
    return coded.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _score(order, backoff, words), "doc_id long, n_words long, log_score double, mean_log_score double")


#: The same scores of order 2 for DuckDB, rounded to six digits.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, unnest(list_prepend(NULL, w[:-2])) AS p FROM d WHERE len(w) > 0),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w), o1 AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
c2 AS (SELECT p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY p, w), o2 AS (SELECT r, p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY r, p, w),
s AS (SELECT r, ln(CASE WHEN h2 > 0 THEN h2::DOUBLE / greatest(hp, 1) ELSE
                   (CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN h1 > 0 THEN h1::DOUBLE ELSE 0.5::DOUBLE END) / others END) AS s
      FROM (SELECT t.r, t.p, c2.n - o2.n AS h2, c1.n - o1.n AS h1, cp.n - op.n AS hp, greatest((SELECT count(*) FROM t) - len(d.w), 1) AS others
            FROM t JOIN d ON d.r = t.r JOIN c1 ON c1.w = t.w JOIN o1 ON o1.r = t.r AND o1.w = t.w
            LEFT JOIN c2 ON c2.p = t.p AND c2.w = t.w LEFT JOIN o2 ON o2.r = t.r AND o2.p = t.p AND o2.w = t.w
            LEFT JOIN c1 cp ON cp.w = t.p LEFT JOIN o1 op ON op.r = t.r AND op.w = t.p)),
g AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(g.s, 0), 6) + 0.0::DOUBLE AS log_score, round(g.s / len(w), 6) AS mean_log_score
FROM d LEFT JOIN g USING (r)"""

"""Language of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from planeweave.llm.common import fixed_hash, in_fold

#: Bound of the labelled sample: rows per language.
SAMPLE = 400
#: Weight rows; a feature's hash chooses its row.
ROWS = 1 << 18
SEGMENT = 48
#: Longest word that is one label of the chain; a longer one is cut into several.
PIECE = 24
#: Stands at an end of a piece where its word goes on; no byte of UTF-8.
OPEN = b"\xff"
#: Words kept with their emissions per worker task.
CACHE = 400_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def labels(text: bytes) -> list[bytes]:
    """The words of a text. One over PIECE bytes is cut into pieces that overlap by two bytes, so that
    each two- and three-byte gram of it stands in one."""
    found = text.split()
    if not found or max(map(len, found)) <= PIECE:
        return found
    out = []
    for w in found:
        if len(w) <= PIECE:
            out.append(w)
            continue
        starts = range(0, len(w) - 2, PIECE - 2)
        out += [(OPEN if i else b"") + w[i:i + PIECE] + (OPEN if i + PIECE < len(w) else b"") for i in starts]
    return out


def word_features(words: list[bytes]) -> np.ndarray:
    """Rows of the weight table for each word: lexicon entry, prefixes and suffixes of one to
    four bytes, and all two- and three-byte grams. Row 0 stands for no feature. An open end of a piece
    is none of its word: there are no prefixes or suffixes there, nor grams with its mark."""
    n = len(words)
    lower = [w.translate(_LOWER) for w in words]
    cut = [(w if w[:1] == OPEN else b"<" + w) + (b"" if w[-1:] == OPEN else b">") for w in lower]
    size = np.array([len(c) for c in cut], np.int64)
    width = max(PIECE + 2, int(size.max(initial=0)))
    grid = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cut), np.uint8).reshape(n, width).astype(np.uint64)
    mix = np.uint64(0x9E3779B97F4A7C15)

    def row(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * mix
        h ^= h >> np.uint64(29)
        return ((h * mix) >> np.uint64(40)) % np.uint64(ROWS - 1) + np.uint64(1)

    out = []
    mark = grid == OPEN[0]
    mark_two = mark[:, :-1] | mark[:, 1:]
    ends = mark[:, 0], mark[np.arange(n), size - 1]
    two = grid[:, :-1] * np.uint64(256) + grid[:, 1:]
    three = two[:, :-1] * np.uint64(256) + grid[:, 2:]
    for k, grams, marked in ((2, two, mark_two), (3, three, mark_two[:, :-1] | mark[:, 2:])):
        rows = row(grams, k)
        rows[marked] = 0
        rows[np.arange(rows.shape[1])[None, :] > (size - k)[:, None]] = 0
        out.append(rows)
    head = np.zeros(n, np.uint64)
    tail = np.zeros(n, np.uint64)
    for k in range(1, 5):  # prefixes and suffixes without the marks
        head = head * np.uint64(257) + grid[:, k]
        at = np.maximum(size - 1 - k, 0)
        tail = tail + grid[np.arange(n), at] * np.uint64(257 ** (k - 1))
        long_enough = size - 2 >= k
        for h, kind, end in ((head, 10 + k, ends[0]), (tail, 20 + k, ends[1])):
            rows = row(h, kind)
            rows[~long_enough | end] = 0
            out.append(rows[:, None])
    whole_word = np.zeros(n, np.uint64)
    for j in range(width):
        whole_word = np.where(j < size, whole_word * np.uint64(1_000_003) + grid[:, j], whole_word)
    out.append(row(whole_word, 30)[:, None])
    return np.concatenate(out, 1).astype(np.int64)


def forward_backward(emit: np.ndarray, size: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (T, B, L) and the sum of pair marginals (L, L) of B chains of ``size`` words.

    Scores are scaled at each word, so chains of any length stay in range. Words past a
    chain's end have all-zero marginals.
    """
    t, b, n = emit.shape
    top = emit.max(2, keepdims=True)
    e, move = np.exp(emit - top), np.exp(step)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    inside = np.arange(t)[:, None] < size[None, :]
    a = e[0] * np.exp(start)
    alpha[0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[i - 1] @ move) * e[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    back = np.full((b, n), 1.0 / n)
    pairs = np.zeros((n, n))
    for i in range(t - 1, -1, -1):
        if i < t - 1:
            follow = e[i + 1] * back
            new = follow @ move.T
            new /= new.sum(1, keepdims=True)
            live = inside[i + 1][:, None]
            both = np.where(live, follow, 0)
            z = ((alpha[i] @ move) * both).sum(1)
            pairs += move * ((alpha[i] / np.where(z > 0, z, 1)[:, None]).T @ both)
            back = np.where(live, new, 1.0 / n)
        beta[i] = back
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    return m * inside[:, :, None], pairs


@dataclass
class Crf:
    """``weights`` (ROWS, L) of the features, ``step`` (L, L) of the transitions, ``start`` (L)."""

    languages: list[str]
    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), np.float32)
        for i in range(0, len(words), 50_000):
            out[i:i + 50_000] = self.weights[word_features(words[i:i + 50_000])].sum(1)
        return out


def fit(texts: list[tuple[str, list[bytes]]], languages: list[str], rounds: int = 2, batch: int = 64, rate: float = 0.1) -> Crf:
    """A field fitted to whole labelled texts by the gradient of the conditional likelihood.

    Texts are cut into segments of SEGMENT words; chains of two segments, each from a text drawn
    by a fixed seed and so often of two languages, teach the transitions what a switch within a
    text looks like. Adagrad on features, transitions and start.
    """
    n = len(languages)
    model = Crf(languages, np.zeros((ROWS, n), np.float32), np.eye(n) * 2.0, np.zeros(n))
    segments = [(languages.index(lang), words[i:i + SEGMENT]) for lang, words in texts for i in range(0, len(words), SEGMENT)]
    dice = np.random.default_rng(7)
    past, past_step, past_start = np.full((ROWS, n), 1e-6, np.float32), np.full((n, n), 1e-6), np.full(n, 1e-6)
    vocabulary = sorted({w for _, words in segments for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    table = np.concatenate([word_features(vocabulary[i:i + 50_000]) for i in range(0, len(vocabulary), 50_000)]) if vocabulary else None
    for _ in range(rounds if len(segments) else 0):
        order = dice.permutation(len(segments))
        for at in range(0, len(order), 2 * batch):
            part = order[at:at + 2 * batch]
            chains = [part[i:i + 2] for i in range(0, len(part), 2)]
            size = np.array([sum(len(segments[s][1]) for s in c) for c in chains])
            words = np.concatenate([[number[w] for w in segments[s][1]] for c in chains for s in c]).astype(np.int64)
            truth = np.concatenate([np.full(len(segments[s][1]), segments[s][0]) for c in chains for s in c])
            chain, place = np.repeat(np.arange(len(chains)), size), np.concatenate([np.arange(k) for k in size])
            kinds, which = np.unique(words, return_inverse=True)
            emit = np.zeros((size.max(), len(chains), n))
            emit[place, chain] = model.weights[table[kinds]].sum(1)[which]
            expected, pairs = forward_backward(emit, size, model.step, model.start)
            slope = -expected[place, chain]
            slope[np.arange(len(truth)), truth] += 1
            by_kind = np.stack([np.bincount(which, slope[:, k], len(kinds)) for k in range(n)], 1)
            rows = table[kinds]
            used, index = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(index.reshape(-1), np.repeat(by_kind[:, k], rows.shape[1]), len(used)) for k in range(n)], 1)
            grad = grad / len(chains) - 1e-4 * model.weights[used]
            grad[used == 0] = 0
            past[used] += grad ** 2
            model.weights[used] += rate * grad / np.sqrt(past[used])
            same = np.flatnonzero(place[1:] > 0)
            seen = np.bincount(truth[same] * n + truth[same + 1], minlength=n * n).reshape(n, n)
            grad_step = (seen - pairs) / len(chains)
            grad_start = (np.bincount(truth[place == 0], minlength=n) - expected[0].sum(0)) / len(chains)
            past_step += grad_step ** 2
            past_start += grad_start ** 2
            model.step += rate * grad_step / np.sqrt(past_step)
            model.start += rate * grad_start / np.sqrt(past_start)
    model.weights[0] = 0
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """A field from at most ``sample`` rows a language outside the held-out fold, the first by a hash
    of their id; their whole texts. None without labelled rows."""
    known = docs.where(~in_fold()).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    languages = [r[0] for r in known.groupBy("lang").count().orderBy("lang").select("lang").collect()]
    if not languages:
        return None
    ids = None
    for lang in languages:  # each takes its first ids by hash, combined before the shuffle
        own = known.where(F.col("lang") == lang).select("doc_id", "lang").orderBy(fixed_hash("doc_id"), "doc_id").limit(sample)
        ids = own if ids is None else ids.unionByName(own)
    rows = known.join(F.broadcast(ids.distinct()), ["doc_id", "lang"], "left_semi").select("lang", F.col("text").cast("binary").alias("text"))
    # Sorted, so that the sample's order, and with it the model, does not depend on partitions.
    return fit(sorted((r[0], labels(bytes(r[1]))) for r in rows.collect()), sorted(languages))


def _batch(model: Crf, texts: list[bytes], cache: dict[bytes, int], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean word marginals (B, L) of whole texts, chains of like length together."""
    rows, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = np.fromiter(map(cache.__getitem__, labels(text)), np.int64)
        rows.append(own)
        sizes[i] = len(own)
    new = len(cache) - sum(len(k) for k in known)
    if new:
        known.append(model.emissions(list(cache)[-new:]))
        known[:] = [np.concatenate(known)]
    table = known[0] if known else np.zeros((0, len(model.languages)), np.float32)
    mean = np.zeros((len(texts), len(model.languages)))
    order = [i for i in np.argsort(sizes, kind="stable") if sizes[i]]
    at = 0
    while at < len(order):
        # About a million words a block: many short chains, or few long ones.
        size = 1
        while at + size < len(order) and size < 1024 and sizes[order[at + size]] * (size + 1) < 400_000 and sizes[order[at + size]] <= 1.3 * sizes[order[at]] + 32:
            size += 1
        part = order[at:at + size]
        at += size
        length = sizes[part]
        emit = np.zeros((int(length.max()), len(part), len(model.languages)))
        for j, i in enumerate(part):
            emit[:sizes[i], j] = table[rows[i]]
        mean[part] = forward_backward(emit, length, model.step, model.start)[0].sum(0) / length[:, None]
    return mean, sizes


def label(docs: DataFrame, model: Crf | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row: the language whose words are likeliest in the mean.

    Every word of the whole text is in the chain, a long one in pieces. A text that is null or has no letter, and any
    text when nothing was learned, is ``und`` with score 0. Ties go to the first language by name.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = defaultdict(count().__next__)
        known: list[np.ndarray] = []
        for batch in batches:
            names, scores = [], []
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 2_000):
                part = texts[i:i + 2_000]
                if len(cache) > CACHE:
                    cache, known = defaultdict(count().__next__), []
                letters = [t is not None and any(c.isalpha() for c in t) and model is not None for t in part]
                if model is None:
                    names += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                mean, sizes = _batch(model, [t.encode() if ok else b"" for t, ok in zip(part, letters)], cache, known)
                best = mean.argmax(1)
                names += [model.languages[k] if ok else "und" for k, ok in zip(best, letters)]
                scores += [float(min(1.0, mean[j, best[j]])) if ok else 0.0 for j, ok in enumerate(letters)]
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (doc_id, text, lang)."""
    return label(docs, train(docs)).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")

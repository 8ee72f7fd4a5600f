"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from planeweave.llm.common import fixed_hash, in_fold, stored, whole

#: Bounds of the training sample: confirmed toxic rows, and unlabelled rows.
POSITIVES = 6_000
UNLABELLED = 12_000
#: Features kept, by how much commoner they are in toxic than in unlabelled texts.
FEATURES = 2_048
PREFIXES = (3, 4, 5, 6)

#: Letters and digits stay (bytes of other alphabets too), A-Z in lower case; all else separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def plain(text: bytes) -> str:
    """Words between single spaces, one character a byte."""
    return " " + b" ".join(text.translate(_LETTERS).split()).decode("latin-1") + " "


def strings(text: bytes) -> set[str]:
    """A text's features: its words (closed by a space) and their beginnings."""
    own = set(plain(text).split())
    return {f" {w} " for w in own} | {" " + w[:k] for w in own for k in PREFIXES if len(w) > k}


@dataclass
class Model:
    """A linear score over the presence of strings; ``bias`` alone for a text without any."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        raw = np.full(len(texts), self.bias)
        if self.weights:
            find = _finder(self.weights)
            for i, text in enumerate(texts):
                raw[i] += sum(self.weights[f] for f in find(text))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _finder(wanted):
    """A function from a text to those wanted strings that it holds, in one pass over the text."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for f in wanted:
        automaton.add_word(f, f)
    automaton.make_automaton()
    return lambda text: sorted({f for _, f in automaton.iter(plain(text))})


def fit(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float,
        steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk under the logistic loss.

    The risk is ``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])``: the loss of
    unlabelled texts as negatives, less what the toxic ones among them must contribute. Where
    the corrected part falls below 0, its gradient is ascended instead. Full batches, Adam.
    ``rows``/``cols`` list the features present; ``positive`` marks the texts of the P sample.
    """
    n, share_p, share_u = len(positive), positive / max(1, positive.sum()), ~positive / max(1, (~positive).sum())
    w = np.zeros(n_features + 1)
    w[-1] = -2.0  # most texts are unlabelled and have no feature
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = np.bincount(rows, w[cols], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        rest = share_u - prior * share_p
        slope = -prior * share_p * (1 - p) + rest * p if rest @ np.logaddexp(0, g) >= 0 else -rest * p
        grad = np.append(np.bincount(cols, slope[rows], n_features), slope.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    # The bias is lowered until unlabelled texts score the prior in the mean, as far as the confirmed toxic texts allow.
    g = np.bincount(rows, w[cols], n)
    marked = g[positive & (np.bincount(rows, minlength=n) > 0)]
    low, high = 1 - float(marked.min()) if len(marked) else w[-1], w[-1]
    for _ in range(50 if low < high else 0):
        middle = (low + high) / 2
        low, high = (low, middle) if share_u @ (1 / (1 + np.exp(-np.clip(g + middle, -30, 30)))) > prior else (middle, high)
    return w[:-1], float(high)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows outside the held-out fold.

    Confirmed toxic rows are at most ``positives``, unlabelled ones at most ``unlabelled``, both
    the first by a hash of their id; only these bounded id lists are broadcast, and only
    feature counts and the samples' chosen features reach the driver. The class prior is the
    toxic share of all labelled rows outside the fold. Without toxic labels every score is about 0.
    """
    open_rows = docs.where(~in_fold()).select("doc_id", whole().alias("text"))
    known = labels.where(~in_fold()).where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic")
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return Model()
    first = lambda ids, n: F.broadcast(ids.distinct().orderBy(fixed_hash("doc_id"), "doc_id").limit(n))
    chosen = open_rows.join(first(known.where("toxic = 1").select("doc_id"), positives), "doc_id", "left_semi").withColumn("p", F.lit(True))
    others = open_rows.join(first(open_rows.where("doc_id IS NOT NULL").select("doc_id"), unlabelled), "doc_id", "left_semi").withColumn("p", F.lit(False))
    sample = stored(chosen.unionByName(others).select(F.col("text").cast("binary").alias("text"), "p"))
    sizes = {r[0]: r[1] for r in sample.groupBy("p").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return Model()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(strings(text))
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["f", "n"])

    held = lambda rows, name: rows.mapInArrow(count, "f string, n long").groupBy("f").agg(F.sum("n").alias(name))
    counts = held(sample.where("p"), "n_p").where(F.col("n_p") >= max(2, sizes[True] // 400))
    seen = held(sample.where("NOT p"), "n_u")
    in_p, in_u = F.col("n_p") / sizes[True], F.coalesce("n_u", F.lit(0)) / sizes[False]
    lift = (in_p - in_u) / F.sqrt(in_p / sizes[True] + (in_u + 1 / sizes[False]) / sizes[False])
    odds = F.lit(prior) * in_p / (in_u + 1 / sizes[False])  # how many of the texts that hold it are toxic
    best = counts.join(seen, "f", "left").where(odds > 0.3).select("f", lift.alias("z")).where("z > 3").orderBy(F.desc("z"), "f").limit(FEATURES)
    wanted = [r[0] for r in best.collect()]
    if not wanted:
        return Model()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = _finder(wanted), {f: i for i, f in enumerate(wanted)}
        for batch in batches:
            yield pa.record_batch([pa.array([[number[f] for f in find(t)] for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["f", "p"])

    found = sample.mapInArrow(present, "f array<int>, p boolean").collect()
    cols = np.array([c for r in found for c in r[0]], np.int64)
    rows = np.repeat(np.arange(len(found)), [len(r[0]) for r in found])
    weights, bias = fit(rows, cols, np.array([r[1] for r in found], bool), len(wanted), prior)
    return Model({f: float(w) for f, w in zip(wanted, weights) if w}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (its ``doc_id`` and any others, with ``text``) with ``__score``; narrow, one pass over each whole text.

    Null text counts as empty; a text without features, empty included, has the score of the bias.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("__score", pa.array(model.scores(batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()), pa.float64()))

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("__score", DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``. Ties and repeated rows score alike; a null id is scored too."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", in_fold().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, their columns unchanged."""
    return score(docs, train(docs, labels)).where("__score < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])

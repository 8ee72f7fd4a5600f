"""Packing documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from planeweave.llm.common import stored, whole

SEQUENCE = 2048
#: Lengths are rounded up to this many tokens in the linear program, so that it has SEQUENCE / UNIT rows at any input size.
UNIT = 16
END = 1
VOCABULARY = "byte_bpe_50k.json"
#: Distinct chunks kept per worker; the memory is given back when there are more.
CACHE = 400_000


# -- token ids ---------------------------------------------------------------------------------

def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 bytes stand for
    themselves, the rest for the characters from code point 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenBytes(dict):
    """Ids of whole texts as little-endian 32-bit bytes.

    A text is cut before each space; a chunk's ids do not depend on what stands around it, so
    each distinct chunk is encoded once and kept. Runs of blanks that a cut would change, and
    texts that spell a special token, go whole to the tokenizer.
    """

    #: Two spaces or more after a blank, or a blank run of two or more that ends the text.
    UNSAFE = re.compile(r"\s  |\s $")

    def __init__(self, path: str):
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in word): i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.encode = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        self[chunk] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def of(self, text: str) -> bytes:
        if self.UNSAFE.search(text) or "\0" in text or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if len(self) > CACHE:
            self.clear()
        chunks = text.replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, chunks if chunks[0] else chunks[1:]))


@functools.cache
def _token_bytes(path: str | None) -> TokenBytes:
    """One per worker process. The default path is looked up where the task runs."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    return TokenBytes(path)


def token_rows(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """``(doc_id, doc_tokens, crcs)``: tokens of each text with the end id, and the CRC of each piece of ``sequence`` ids."""
    end, step = struct.pack("<I", END), 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _token_bytes(path)
        for batch in batches:
            n, crcs = [], []
            for text in batch.column(1):
                ids = tokens.of(text.as_py()) + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(memoryview(ids)[i:i + step]) for i in range(0, len(ids), step)])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])
        tokens.clear()  # the worker process outlives the task

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, f"doc_id {kind}, doc_tokens long, crcs array<long>")


# -- cutting stock -----------------------------------------------------------------------------

def _best_column(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over the capacity: the dearest pattern that fits."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c], fits = value[c - 1], sizes <= c
        if fits.any():
            gain = np.where(fits, prices + value[np.maximum(c - sizes, 0)], -1.0)
            k = int(gain.argmax())
            if gain[k] > value[c] + 1e-12:
                value[c], choice[c] = gain[k], k
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return value[capacity], pattern


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(pieces per size, copies)`` that cover the demand exactly, in few sequences.

    The linear program's columns are generated by pricing with the knapsack until none is
    worth entering; its solution is rounded down, and what is left is filled largest first.
    The histogram has at most ``capacity`` sizes, whatever the number of documents.
    """
    sizes = np.array(sorted(k for k, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[k] for k in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * len(sizes)):  # a basis is a valid plan at any time
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, column = _best_column(prices, sizes, capacity)
        if worth <= 1 + 1e-9:
            break
        held, turn = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(turn > 1e-9, np.maximum(held, 0) / np.where(turn > 1e-9, turn, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    copies = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(int)
    left, out = need.astype(int).copy(), []
    for p in range(len(sizes)):
        use = basis[:, p].astype(int)
        copies[p] = min([copies[p], *(left[use > 0] // use[use > 0])])
        if copies[p]:
            left -= use * copies[p]
            out.append(({int(sizes[i]): int(use[i]) for i in np.flatnonzero(use)}, int(copies[p])))
    while left.any():
        room, use = capacity, np.zeros(len(sizes), int)
        for i in range(len(sizes))[::-1]:
            use[i] = min(left[i], room // sizes[i])
            room -= use[i] * sizes[i]
        times = int((left[use > 0] // use[use > 0]).min())
        left -= use * times
        out.append(({int(sizes[i]): int(use[i]) for i in np.flatnonzero(use)}, times))
    return out


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, unit: int = UNIT, rows_per_cell: int = 1 << 20) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is cut at multiples of ``sequence``; its full pieces are sequences of their own,
    and its last piece (1 to ``sequence`` tokens) is an item of the cutting-stock problem, sized
    in units. Items are ranked within their size, by cells of about ``rows_per_cell`` rows so
    that a frequent size is no single task, and the n-th item of a size takes its n-th place in
    the patterns. Only the histogram (at most sequence / unit rows) reaches the driver.

    Null or empty text is the end id alone: one piece of length 1. Repeated rows and null ids
    are packed as rows of their own; other columns are ignored; an empty table gives no rows.
    """
    tokens = stored(token_rows(docs, path, sequence))
    last = F.pmod(F.col("doc_tokens") - 1, F.lit(sequence)) + 1
    tokens = tokens.withColumn("_last", last).withColumn("_full", ((F.col("doc_tokens") - F.col("_last")) / sequence).cast("long"))
    tokens = tokens.withColumn("_size", F.ceil(F.col("_last") / unit).cast("int"))
    histogram = {r[0]: r[1] for r in tokens.groupBy("_size").count().collect()}
    plan = patterns(histogram, sequence // unit)
    # For each size: the first rank, first sequence and pieces per sequence of its run in each pattern.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequences = 0
    for use, copies in plan:
        for size, times in use.items():
            runs.setdefault(size, []).append((taken.get(size, 0), sequences, times))
            taken[size] = taken.get(size, 0) + times * copies
        sequences += copies
    cells = max(1, sum(histogram.values()) // rows_per_cell)
    cell = ["_size", "_cell"]
    tokens = tokens.withColumn("_cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    per = tokens.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.sum("_full").alias("_f"))
    before = Window.partitionBy("_size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole_order = Window.orderBy("_size", "_cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell, not per document
    per = per.select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"), F.coalesce(F.sum("_f").over(whole_order), F.lit(0)).alias("_full0"))
    within = Window.partitionBy(*cell).orderBy("_last", "doc_id", "crcs")
    ranked = tokens.withColumn("_rank", F.row_number().over(within) - 1).withColumn(
        "_fulls", F.sum("_full").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_full")).join(per, cell)
    ranked = ranked.withColumns({"_rank": F.col("_rank") + F.col("_rank0"), "_fulls": F.col("_fulls") + F.col("_full0") + F.lit(sequences)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.array(v, np.int64) for k, v in runs.items()}
        for batch in batches:
            size, rank = batch.column("_size").to_numpy(), batch.column("_rank").to_numpy()
            at = np.zeros(len(size), np.int64)
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                run = tables[int(k)][np.searchsorted(tables[int(k)][:, 0], rank[own], side="right") - 1]
                at[own] = run[:, 1] + (rank[own] - run[:, 0]) // run[:, 2]
            yield batch.append_column("_sequence", pa.array(at))

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked.select("doc_id", "doc_tokens", "crcs", "_last", "_full", "_size", "_fulls", F.col("_rank").cast("long").alias("_rank")).mapInArrow(
        place, f"doc_id {kind}, doc_tokens long, crcs array<long>, _last long, _full long, _size int, _fulls long, _rank long, _sequence long")
    pieces = placed.select("*", F.posexplode("crcs").alias("_i", "ids_crc32"))
    is_last = F.col("_i") == F.col("_full")
    pieces = pieces.select(
        "doc_id", (F.col("_i") * F.lit(sequence)).cast("long").alias("start"), F.when(is_last, F.col("_last")).otherwise(F.lit(sequence)).cast("long").alias("length"),
        "ids_crc32", "doc_tokens", F.when(is_last, F.col("_sequence")).otherwise(F.col("_fulls") + F.col("_i")).cast("long").alias("sequence_id"), "_rank", "_size")
    along = Window.partitionBy("sequence_id").orderBy("_size", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long").alias("offset"))

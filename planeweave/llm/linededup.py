"""Reversible line dedup: exact reference counts of lines, screened by sharded cuckoo filters.

A line's key is 128 bits of its stripped, lower-cased text. References are (key, document)
pairs; counts say how many documents hold a key and which is the smallest. Keys held by two
documents or more are *shared*: they alone can make a document lose lines, and they alone are
in the cuckoo filters, one filter per shard of the key space. Counts going from one to two
insert into the filter, counts falling back to one delete from it, so that adding documents
and taking them out again restores the state. A filter only screens: the exact table decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from planeweave.llm.common import stored, whole

MIN_POINTS = 10
#: Filters are handed to every task only up to this size in bytes; beyond it the exact join alone decides.
SCREEN_BYTES = 32 << 20
KEYS_PER_SHARD = 50_000
NO_ID = (1 << 63) - 1


class CuckooFilter:
    """Four 16-bit fingerprints a bucket; each key has two buckets, either found from the other."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.mask = np.uint64(buckets - 1)
        self.cells = np.zeros((buckets, 4), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(buckets, 4).copy()

    @classmethod
    def of(cls, keys: np.ndarray) -> "CuckooFilter":
        """A filter of these distinct keys, at most 80 % full; doubled until all fit."""
        buckets = 16
        while buckets * 4 * 0.8 < len(keys):
            buckets *= 2
        while True:
            made = cls(buckets)
            if made.insert(keys):
                return made
            buckets *= 2

    @classmethod
    def read(cls, cells: bytes) -> "CuckooFilter":
        return cls(len(cells) // 8, cells)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        return np.where(mark == 0, np.uint16(1), mark), ((keys[:, 1] >> np.uint64(16)) & self.mask).astype(np.int64)

    def _other(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        mixed = mark.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)
        return at ^ ((mixed >> np.uint64(20)) & self.mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some found no room; the caller then builds a larger filter from the exact table."""
        mark, at = self._places(keys)
        dice = np.random.default_rng(len(keys))
        for turn in range(400):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            new = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            empty = self.cells[at] == 0
            fits = rank < empty.sum(1)
            slot = (np.cumsum(empty, 1) == (rank + 1)[:, None]).argmax(1)
            self.cells[at[fits], slot[fits]] = mark[fits]
            mark, at, rank = mark[~fits], at[~fits], rank[~fits]
            if turn > 2 and len(mark):  # both buckets are full: one key a bucket takes a random slot
                one = np.r_[True, at[1:] != at[:-1]]
                where, which = at[one], dice.integers(0, 4, int(one.sum()))
                out = self.cells[where, which].copy()
                self.cells[where, which] = mark[one]
                mark[one] = out
            at = self._other(mark, at)
        return not len(mark)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, at = self._places(keys)
        return (self.cells[at] == mark[:, None]).any(1) | (self.cells[self._other(mark, at)] == mark[:, None]).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint for each key; only keys that were inserted may be given."""
        mark, at = self._places(keys)
        while len(mark):
            second = self._other(mark, at)
            here = (self.cells[at] == mark[:, None]).any(1)
            place = np.where(here, at, second)
            hit = self.cells[place] == mark[:, None]
            cell = place * 4 + hit.argmax(1)
            _, first = np.unique(cell, return_index=True)
            found = np.zeros(len(mark), bool)
            found[first] = True
            self.cells.reshape(-1)[cell[found & hit.any(1)]] = 0
            keep = ~found & hit.any(1)
            mark, at = mark[keep], at[keep]


def _key(line: bytes) -> bytes | None:
    """16 bytes, or None for a line of under ten code points. Strips and lower-cases ASCII only."""
    line = line.strip().lower()
    if len(line) < MIN_POINTS or len(line) < 4 * MIN_POINTS and len(line.decode("utf-8", "replace")) < MIN_POINTS:
        return None
    return xxhash.xxh3_128_digest(line)


def _numbers(keys: pa.Array) -> np.ndarray:
    keys = keys.cast(pa.binary(16)) if len(keys) else keys
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def _shard(shards: int):
    """Shard of a key column, from its first four bytes."""
    return F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % shards


def line_keys(docs: DataFrame, screen: dict[int, bytes] | None = None) -> DataFrame:
    """``(key, doc_id)``: the distinct keys of each row; with ``screen``, those that its filters hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: CuckooFilter.read(v) for k, v in (screen or {}).items()}
        for batch in batches:
            keys, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = {_key(x) for x in text.split(b"\n")} - {None}
                keys += own
                ids += [doc] * len(own)
            out = pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])
            if screen is not None and keys:
                n = _numbers(out.column(0))
                shard = (n[:, 0] >> np.uint64(32)) % np.uint64(len(screen))
                maybe = np.zeros(len(n), bool)
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    maybe[at] = filters[int(s)].contains(n[at])
                out = out.filter(pa.array(maybe))
            yield out

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "key binary, doc_id long")


def _counts(references: DataFrame) -> DataFrame:
    """Counts combine before the shuffle, so a line of very many documents is one row per task."""
    return references.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"))


@dataclass
class LineIndex:
    """``references`` (key, doc_id), distinct; ``shared`` (key, n_docs, first_doc) of the keys in two
    documents or more; ``filters`` (shard, cells) over the shared keys; ``shards`` of them."""

    references: DataFrame
    shared: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def build(cls, docs: DataFrame) -> "LineIndex":
        """All documents inserted into an empty index. Empty input gives an empty index."""
        references = line_keys(docs)
        shared = stored(_counts(references).where("first_doc <> last_doc").select("key", "n_docs", "first_doc"))
        shards = 16
        n = shared.count()
        while shards * KEYS_PER_SHARD < n:
            shards *= 2
        return cls(references, shared, _filters(shared, shards), shards)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index with these documents added. Only keys of the new documents are counted again."""
        new = stored(line_keys(docs).distinct())
        touched = new.select("key").distinct()
        references = stored(self.references.unionByName(new).distinct())
        return self._moved(references, touched)

    def delete(self, ids: DataFrame) -> "LineIndex":
        """The index without the documents whose ids ``ids`` (doc_id) lists; ids not held change nothing."""
        ids = ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct()
        touched = self.references.join(ids, "doc_id", "left_semi").select("key").distinct()
        return self._moved(stored(self.references.join(ids, "doc_id", "left_anti")), touched)

    def _moved(self, references: DataFrame, touched: DataFrame) -> "LineIndex":
        touched = stored(touched)
        again = _counts(references.join(touched, "key", "left_semi")).where("first_doc <> last_doc").select("key", "n_docs", "first_doc")
        shared = stored(self.shared.join(touched, "key", "left_anti").unionByName(again))
        come = shared.join(self.shared, "key", "left_anti").select("key", F.lit(True).alias("add"))
        gone = self.shared.join(shared, "key", "left_anti").select("key", F.lit(False).alias("add"))
        changes = come.unionByName(gone).withColumn("shard", _shard(self.shards))

        def change(key, left, right):
            held = CuckooFilter.read(left.column("cells")[0].as_py())
            add = right.column("add").to_numpy(zero_copy_only=False).astype(bool)
            n = _numbers(right.column("key").combine_chunks())
            held.delete(n[~add])
            if not held.insert(n[add]):
                return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([None], pa.binary())})
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([held.cells.tobytes()], pa.binary())})

        filters = stored(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, "shard long, cells binary"))
        if filters.where("cells IS NULL").limit(1).count():  # a shard has overflowed: build all from the exact table, with more shards
            return LineIndex(references, shared, _filters(shared, 2 * self.shards), 2 * self.shards)
        return LineIndex(references, shared, filters, self.shards)

    def screen(self) -> dict[int, bytes] | None:
        """The filters' cells by shard, if they are together within SCREEN_BYTES."""
        size = self.filters.agg(F.sum(F.length("cells"))).first()[0]
        return None if size > SCREEN_BYTES else {s: bytes(c) for s, c in self.filters.collect()}


def _filters(shared: DataFrame, shards: int) -> DataFrame:
    """One filter per shard, empty shards included."""
    def make(key, rows):
        keys = rows.column("key").combine_chunks().drop_null()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "cells": pa.array([CuckooFilter.of(_numbers(keys)).cells.tobytes()], pa.binary())})

    every = shared.sparkSession.range(shards).select(F.lit(None).cast("binary").alias("key"), F.col("id").alias("shard"))
    return stored(shared.select("key", _shard(shards).alias("shard")).unionByName(every).groupBy("shard").applyInArrow(make, "shard long, cells binary"))


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns __text and __lost in; __text, __n_lines, __n_dropped out, the others as they are."""
    for batch in batches:
        named = dict(zip(batch.schema.names, batch.columns))
        texts, n_lines, n_dropped = [], [], []
        for text, lost in zip(named["__text"].cast(pa.binary()).to_pylist(), named.pop("__lost").to_pylist()):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if lost:
                lost = set(lost)
                lines = [x for x in lines if _key(x) not in lost]
                text = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            texts.append(text)
        named["__text"] = pa.array(texts, pa.binary()).cast(pa.string())
        named |= {"__n_lines": pa.array(n_lines, pa.int64()), "__n_dropped": pa.array(n_dropped, pa.int64())}
        yield pa.record_batch(named)


def clean(docs: DataFrame, index: LineIndex) -> DataFrame:
    """All columns of ``docs`` and ``__text``, ``__n_lines``, ``__n_dropped``: each text without its
    lines whose key a smaller document holds.

    Null or empty text is one empty line and loses nothing. A null id counts as the largest.
    Rows that share an id are one document: a key that they alone hold is not shared, and each
    keeps its lines. The screen lets only likely shared keys reach the exact join, which adaptive
    execution splits where one key has very many documents. Names beginning with ``__`` are ours.
    """
    held = line_keys(docs, index.screen())
    lost = held.join(index.shared.select("key", "first_doc"), "key").where("doc_id <> first_doc").groupBy(
        F.col("doc_id").alias("__id")).agg(F.collect_set("key").alias("__lost"))
    rows = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(NO_ID)), "__text": whole()})
    rows = rows.select("__id", "__text", *[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    joined = rows.join(lost, "__id", "left").drop("__id")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "__lost"] + ["__n_lines long", "__n_dropped long"])
    return joined.mapInArrow(_drop, schema)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    return clean(docs, LineIndex.build(docs)).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__text").cast("binary"), 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents with their columns in order, repeated lines dropped from ``text``; a text that
    loses nothing (null included) stays as it is. ``n_chars``, where there is such a column, follows the text."""
    out = clean(docs.withColumn("__null", F.col("text").isNull()), LineIndex.build(docs))
    new = {"text": F.when(F.col("__null"), F.lit(None)).otherwise(F.col("__text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__n_dropped") > 0, F.length("__text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


#: Whole-table counts of the keys, for DuckDB.
SQL = r"""
WITH l AS (SELECT r, doc_id, i, x, translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(range(len(l))) AS i, unnest(l) AS x
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
s AS (SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT r, l.doc_id, i, x, s.k IS NOT NULL AND l.doc_id <> s.first_doc AS gone FROM l LEFT JOIN s USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY r, doc_id"""

"""Exact n-gram Jaccard join by prefix lists, with skipping by position and by set relations.

The pieces, each a Spark job over rows that it shuffles by key:

1. *Sets.* Every whole text becomes the set of its word shingles, as 64-bit hashes. Equal sets
   have one 128-bit name and are one set from here on.
2. *Order.* A count sketch of fixed size orders shingles from rare to frequent. Any order that is
   the same for all sets gives right results; this one keeps common passages out of prefixes.
3. *Lists.* Two sets that link share a shingle of both their prefixes (size - ceil(t size) + 1
   first shingles). A shingle held by one prefix only is dropped where its list comes together.
   Shingles that the very same sets hold are one list, with their number: pairs that share
   a thousand shingles meet once for each list, not once for each shingle. Since the order is the
   same for all sets, the first of these shingles is the first for each of them.
4. *Leaders.* In each list, cut in blocks by size, the smallest set is the candidate leader of the
   block; each set is compared with the leader that most of its lists name. One that links to it
   has its distance to the leader as a computed answer.
5. *Skipping.* Lists whose sets are all connected by now are skipped whole. In the others, blocks by
   leader are joined where sizes and positions allow a link, and pairs of leaders whose parity bitmaps
   already tell that they are too far apart are skipped, without their texts. For the rest the leaders alone are
   compared; since the Jaccard distance obeys the
   triangle inequality, the answers of a leader's followers derive from its own: only where
   d(r1, r2) <= 1 - t + d(x, r1) + d(y, r2), and x and y are not connected yet, are x and y compared.

No step emits all pairs of a group of near copies, and none leaves out a pair that could link
two components.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from planeweave.llm.common import stored
from planeweave.operators.components import contract

#: Words in a shingle, and the least similarity in hundredths.
WIDTH = 5
PERCENT = 75
#: Cells of the frequency sketch, and cells in each of its blocks.
CELLS = 1 << 21
BLOCK = 1 << 14
#: Bits of the screen over wanted documents.
SCREEN = 1 << 23
POSTINGS_PER_BUCKET = 500_000
#: A shingle whose sketched count reaches this is dealt by set as well, so that no list is one task's.
HOT = 1 << 17
FOLLOWERS_PER_TASK = 256
#: Texts whose entries are packed together.
PACKED = 2_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


class _Words(dict):
    """64-bit hash of each word, kept up to a number of words."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, hashes: _Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; a text of fewer words is one shingle, without words none."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII blanks split
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    g = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        g = (g * _STEP) ^ h[k:len(h) - n + 1 + k]
        g *= _MIX
        g ^= g >> np.uint64(32)
    return np.unique(g)


def name(members: np.ndarray) -> bytes:
    """128-bit name of a set: equal sets have equal names."""
    return xxhash.xxh3_128_digest(members.tobytes())


def parities(members: np.ndarray) -> bytes:
    """For each cell of a bitmap whether an odd number of shingles falls on it; two to four cells a shingle.

    Where the bitmaps of two sets differ, at least one shingle is in one set only: they tell how far
    apart two sets are at least. A larger bitmap folds to the size of a smaller one.
    """
    cells = min(1 << 17, max(64, 1 << int(2 * len(members) - 1).bit_length()))
    return np.packbits(np.bincount((members >> np.uint64(40)).astype(np.int64) % cells, minlength=cells) & 1 == 1).tobytes()


def _least_distance(n_a: int, a: bytes, n_b: int, b: bytes) -> float:
    """No more than the Jaccard distance of two sets of these sizes and bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, size)) ^ np.bitwise_xor.reduce(y.reshape(-1, size))).sum())
    both = min((n_a + n_b - differ) / 2, n_a, n_b)
    return 1 - both / (n_a + n_b - both)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens % np.uint64(CELLS)).astype(np.int64)


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


# -- sets and order ----------------------------------------------------------------------------

def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (doc_id, n, set, bits) and, per task, its part of the sketch by block (block, cells)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = _Words(), np.zeros(CELLS, np.uint32)
        for batch in batches:
            sizes, names, bits = [], [], []
            for text in _bytes(batch.column(1)):
                s = shingles(text, hashes, width)
                np.add.at(cells, _cell(s), 1)
                sizes.append(len(s))
                names.append(name(s))
                bits.append(parities(s) if len(s) else None)
            k = len(sizes)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bits, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                                  ["doc_id", "n", "set", "bits", "block", "cells"])
        blocks = [(b, zlib.compress(cells[b * BLOCK:(b + 1) * BLOCK].tobytes(), 1)) for b in range(CELLS // BLOCK) if cells[b * BLOCK:(b + 1) * BLOCK].any()]
        k = len(blocks)
        yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array([b for b, _ in blocks], pa.int32()),
                               pa.array([c for _, c in blocks], pa.binary())], ["doc_id", "n", "set", "bits", "block", "cells"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set binary, bits binary, block int, cells binary"))


def _sketch(scan: DataFrame) -> np.ndarray:
    """The whole sketch: CELLS counts, whatever the input."""
    def add(key, rows):
        total = np.zeros(BLOCK, np.int64)
        for c in rows.column("cells").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.int64)
    for b, c in scan.where("block IS NOT NULL").select("block", "cells").groupBy("block").applyInArrow(add, "block int, cells binary").collect():
        out[b * BLOCK:(b + 1) * BLOCK] = np.frombuffer(c, np.int64)
    return out


# -- prefix lists ------------------------------------------------------------------------------

def _prefix(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by the columns, and where runs of equal rows start in it."""
    order = np.lexsort(columns[::-1])
    return order, np.flatnonzero(_starts(*[c[order] for c in columns]))


def _lists(docs: DataFrame, sketch: np.ndarray, total: int, width: int, percent: int) -> DataFrame:
    """``(list, set, n, pos, times)``: the prefix entries whose shingle is in two prefixes or more.

    ``list`` names the sets that hold a shingle, ``times`` counts the shingles of this list and ``pos`` is
    the place of the first; a list's parts from several buckets are still to be added up. Two lists under one
    name would only give more candidates.

    Entries travel packed, by bucket of their shingle; the number of buckets follows the number
    of shingles, so that a bucket's size does not. Shingles that may be hot by the sketch, which
    never counts too low, go to buckets by set and are passed on as they are.
    """
    buckets = max(1, math.ceil(total * (100 - percent) / 100 / POSTINGS_PER_BUCKET))
    rank = np.minimum(255, 8 * np.log2(1.0 + sketch)).astype(np.uint8)
    hot = np.packbits(sketch >= HOT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, press = _Words(), zstandard.ZstdCompressor(1)
        is_hot = np.unpackbits(hot)[:CELLS].astype(bool)
        for batch in (b.slice(i, PACKED) for b in batches for i in range(0, b.num_rows, PACKED)):
            seen: set[bytes] = set()
            tokens, owners, sizes, names = [], [], [], []
            for text in _bytes(batch.column(0)):
                s = shingles(text, hashes, width)
                if not len(s) or (own := name(s)) in seen:
                    continue
                seen.add(own)
                first = s[np.argsort(rank[_cell(s)], kind="stable")[:_prefix(len(s), percent)]]
                owners.append(np.full(len(first), len(names), np.int64))
                tokens.append(first)
                names.append(own)
                sizes.append(len(s))
            if not names:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owners)
            pos = np.concatenate([np.arange(len(t)) for t in tokens])
            mixed = (token * _MIX) >> np.uint64(20)
            bucket = (mixed % np.uint64(buckets)).astype(np.int64)
            name_of = np.frombuffer(b"".join(names), np.uint8).reshape(-1, 16)
            salt = name_of[owner, :4].astype(np.int64) @ np.array([1, 256, 65536, 16777216])
            bucket = np.where(is_hot[_cell(token)], buckets + salt % buckets, bucket)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            size_of = np.array(sizes, np.int32)
            keys, parts = [], []
            for at in np.split(order, cuts):
                o = owner[at]
                keys.append(int(bucket[at[0]]))
                parts.append(press.compress(b"".join((token[at].tobytes(), pos[at].astype(np.int32).tobytes(), size_of[o].tobytes(), name_of[o].T.tobytes()))))
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["bucket", "part"])

    def meet(key, rows):
        undo = zstandard.ZstdDecompressor()
        token, pos, size, names = [], [], [], []
        for part in rows.column("part").to_pylist():
            raw = undo.decompress(part)
            n = len(raw) // 32
            token.append(np.frombuffer(raw, np.uint64, n))
            pos.append(np.frombuffer(raw, np.int32, n, 8 * n))
            size.append(np.frombuffer(raw, np.int32, n, 12 * n))
            names.append(np.frombuffer(raw, np.uint8, 16 * n, 16 * n).reshape(16, n).T)
        token, pos, size, names = (np.concatenate(x) for x in (token, pos, size, names))
        lo, hi = np.ascontiguousarray(names).view(np.uint64).T
        times = np.ones(len(token), np.int32)
        if key[0].as_py() < buckets:
            # Copies of a set hold a shingle once.
            order, first = _runs(token, lo, hi)
            at = order[first]
            first = np.flatnonzero(_starts(token[at]))
            held = np.diff(np.append(first, len(at)))
            of = np.add.reduceat((lo[at] ^ (hi[at] * _STEP)) * _MIX, first) if len(at) else np.zeros(0, np.uint64)
            keep = np.repeat(held > 1, held)
            at, lists = at[keep], np.repeat(of, held)[keep]
            # Shingles of one list.
            order, first = _runs(lists, lo[at], hi[at])
            pos = np.minimum.reduceat(pos[at[order]], first) if len(first) else pos[:0]
            times = np.diff(np.append(first, len(order))).astype(np.int32)
            token, at = lists[order[first]], at[order[first]]
            size, names = size[at], np.ascontiguousarray(names[at])
        flat = names.tobytes()
        return pa.table({"list": pa.array(token.view(np.int64)), "set": pa.array([flat[i:i + 16] for i in range(0, len(flat), 16)], pa.binary()),
                         "n": pa.array(size), "pos": pa.array(pos), "times": pa.array(times)})

    packed = docs.select("text").mapInArrow(pack, "bucket long, part binary")
    return packed.groupBy("bucket").applyInArrow(meet, "list long, set binary, n int, pos int, times int")


# -- comparing ---------------------------------------------------------------------------------

def _screen_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which every wanted id has its bit."""
    hashed = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(SCREEN)).alias("h"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SCREEN, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy()] = True
        whole = np.packbits(bits).reshape(64, -1)
        used = [b for b in range(64) if whole[b].any()]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([zlib.compress(whole[b].tobytes(), 1) for b in used], pa.binary())], ["block", "bits"])

    def either(key, rows):
        out = np.zeros(SCREEN // 512, np.uint8)
        for x in rows.column("bits").to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    bits = np.zeros((64, SCREEN // 512), np.uint8)
    for b, x in hashed.mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary").collect():
        bits[b] = np.frombuffer(x, np.uint8)
    return bits.reshape(-1)


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Of the pairs ``(a, b, far)`` those whose bitmaps, ``(id, n, bits)``, allow a distance of 1 - t + far."""
    most = 1 - percent / 100 + 1e-9
    for c in "ab":
        pairs = pairs.join(bits.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PACKED) for b in batches for i in range(0, b.num_rows, PACKED)):
            far, *rest = (batch.column(c).to_pylist() for c in range(2, 7))
            near = [_least_distance(*r) <= most + f for f, *r in zip(far, *rest)]
            yield batch.select(["a", "b", "far"]).filter(pa.array(near, pa.bool_()))

    return pairs.select("a", "b", "far", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(keep, "a long, b long, far double")


def compare(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """``(a, b, both, n_a, n_b)``: sizes of the two sets and of their intersection for each pair of ids.

    ``sets`` (id, set, doc_id) says which document shows a set. Texts are read again, past a screen
    of fixed size over the wanted documents, and sent to the pairs that need them, compressed. A set
    in very many pairs is sent to several tasks, each of which meets a part of its partners; a
    task holds one leader's set at a time.
    """
    pairs = stored(pairs.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = stored(sets.join(wanted, "id", "left_semi").select("id", "set", "doc_id"))
    screen = _screen_of(wanted)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(1)
        for batch in batches:
            h = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((screen[h >> 3] >> (7 - (h & 7)).astype(np.uint8) & 1).astype(bool)))
            words = [press.compress(b" ".join((t or b"").lower().split())) for t in _bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(words, pa.binary())], ["doc_id", "words"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(SCREEN)).alias("_h"))
    texts = rows.mapInArrow(fetch, "doc_id long, words binary").join(wanted, "doc_id").select("id", "set", "words")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS_PER_TASK).cast("long").alias("_parts"))
    asked = pairs.join(parts, "a").select(F.col("b").alias("id"), F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("_parts")).alias("_part"), F.lit(1).alias("_turn"))
    leaders = parts.select(F.col("a").alias("id"), F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), F.lit(0).alias("_turn"))
    met = asked.unionByName(leaders).join(texts, "id").repartition("key", "_part").sortWithinPartitions("key", "_part", "_turn", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, undo = _Words(), zstandard.ZstdDecompressor()
        lead, key = np.zeros(0, np.uint64), None
        for batch in (b.slice(i, PACKED) for b in batches for i in range(0, b.num_rows, PACKED)):
            a, b, both, n_a, n_b = [], [], [], [], []
            for own, k, turn, called, words in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "_turn", "set", "words"))):
                s = shingles(undo.decompress(words), hashes, width)
                if name(s) != called:  # another text under the same document id
                    continue
                if turn == 0:
                    lead, key = s, k
                elif k == key:
                    a.append(k)
                    b.append(own)
                    both.append(len(np.intersect1d(lead, s, assume_unique=True)))
                    n_a.append(len(lead))
                    n_b.append(len(s))
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (a, b, both, n_a, n_b)], ["a", "b", "both", "n_a", "n_b"])

    return stored(met.mapInArrow(meet, "a long, b long, both long, n_a long, n_b long").distinct())


def _linked(percent: int):
    return F.expr(f"100 * both >= {percent} * (n_a + n_b - both)")


_DISTANCE = "1 - both / (n_a + n_b - both)"


def _roots(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(id, root)`` for every set of an edge that is not the smallest of its component; with ``roots``,
    those of the edges so far, which new edges only join."""
    if roots is not None:
        for c in ("a", "b"):
            edges = edges.join(roots.select(F.col("id").alias(c), F.col("root").alias("_r")), c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        edges = edges.where("a <> b")
    new = contract(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), []).select(F.col("u").alias("id"), F.col("v").alias("root"))
    if roots is None:
        return new
    moved = roots.join(new.select(F.col("id").alias("root"), F.col("root").alias("_to")), "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    return stored(moved.unionByName(new))


# -- the join ----------------------------------------------------------------------------------

def _named(rows: DataFrame) -> DataFrame:
    """``(set, n, id, doc_id)``: a number for each distinct non-empty set, that of its smallest document.

    A document id that shows two sets, or none at all, gives no name to a set; such a set is
    numbered by its hash, below zero.
    """
    sets = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    twice = sets.groupBy(F.col("doc_id").alias("_doc")).count().where("count > 1 OR _doc IS NULL").select("_doc", F.lit(True).alias("_twice"))
    named = sets.join(twice, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return stored(named.select("set", "n", "doc_id", F.when(F.col("_twice"), -F.pmod(F.xxhash64("set"), F.lit(1 << 62)) - 1).otherwise(F.col("doc_id")).alias("id")))


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n, set, class)`` of every row: the name of its set and the number of its class.

    Sets are in one class when a chain of pairs of at least ``percent`` similarity joins them.
    An empty set has no class.
    """
    scan = _scan(docs, width)
    rows = scan.where("block IS NULL").select("doc_id", "n", "set", "bits")
    total = rows.agg(F.sum("n")).first()[0] or 0
    sets = _named(rows)
    lists = _lists(docs, _sketch(scan), total, width, percent).join(sets.select("set", "id"), "set")
    entries = stored(lists.groupBy("list", "id").agg(F.max("n").alias("n"), F.min("pos").alias("pos"), F.sum("times").alias("times")))
    shown = sets.join(entries.select("id").distinct(), "id", "left_semi").select("id", F.col("set").alias("_set"), F.col("doc_id").alias("_doc"))
    bits = rows.join(shown, (F.col("set") == F.col("_set")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("id", "n", "bits")
    bits = stored(bits.dropDuplicates(["id"]))
    t = percent / 100

    # Leaders by block of a list: the first set of the block.
    at = entries.withColumn("_block", F.floor(F.log(F.col("n").cast("double")) / -math.log(t)).cast("int"))
    head = at.groupBy("list", "_block").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    votes = at.join(head, ["list", "_block"]).where("id <> lead").groupBy("id", "lead").agg(F.sum("times").alias("count"))
    best = votes.groupBy("id").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead"))
    best = best.select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("far"))
    answers = compare(possible(best, bits, percent), docs, sets, width)
    close = answers.where(_linked(percent))
    roots = _roots(close.select("a", "b"))
    leader = stored(close.select(F.col("b").alias("id"), F.col("a").alias("lead"), F.expr(_DISTANCE).alias("far")))

    def classed(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))

    # Lists that are not of one class yet.
    known = classed(entries, roots)
    apart = known.groupBy("list").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("list")
    open_rows = known.join(apart, "list", "left_semi").join(leader, "id", "left")
    open_rows = stored(open_rows.withColumns({"lead": F.coalesce("lead", "id"), "far": F.coalesce("far", F.lit(0.0))}))

    # Blocks by leader. The first shingle that two sets share has all of their overlap behind it in both, so only
    # blocks that stand far enough in front meet; of their leaders' pairs the bitmaps tell which are too far apart.
    blocks = open_rows.groupBy("list", "lead", "root").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("far").alias("far"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = (F.col("x.hi") >= t * F.col("y.lo")) & (F.col("y.hi") >= t * F.col("x.lo"))
    least = F.ceil(F.greatest((F.col("x.lo") + F.col("y.lo")) * (t / (1 + t)), F.greatest("x.lo", "y.lo") * t) - 1e-9)
    met = x.join(y, (F.col("x.list") == F.col("y.list")) & (F.col("x.lead") < F.col("y.lead")) & (F.col("x.root") != F.col("y.root")) & sizes
                 & (F.least("x.rest", "y.rest") >= least))
    pairs = met.groupBy(F.col("x.lead").alias("a"), F.col("y.lead").alias("b")).agg(F.max(F.col("x.far") + F.col("y.far")).alias("far"))
    pairs = stored(possible(pairs, bits, percent))
    if pairs.limit(1).count():
        between = compare(pairs, docs, sets, width)
        roots = _roots(between.where(_linked(percent)).select("a", "b"), roots)
        # Followers of leaders that are near enough for some of theirs to link.
        near = between.join(pairs, ["a", "b"]).select("a", "b", F.expr(_DISTANCE).alias("apart"), "far").where(f"far > 0 AND apart <= {1 - t} + far + 1e-9").select("a", "b", "apart")
        open_rows = classed(open_rows.drop("root"), roots)
        # Only lists in which blocks of both leaders stand, and only followers far enough from their leader.
        lists = met.where(F.col("x.far") + F.col("y.far") > 0).select(
            F.col("x.lead").alias("a"), F.col("y.lead").alias("b"), F.col("x.list").alias("list"), F.col("x.far").alias("_fa"), F.col("y.far").alias("_fb"))
        lists = lists.join(near, ["a", "b"]).where(F.col("apart") <= 1 - t + F.col("_fa") + F.col("_fb") + 1e-9)
        x = open_rows.select("list", F.col("lead").alias("a"), F.struct("id", "n", "pos", "far", "root").alias("x"))
        y = open_rows.select("list", F.col("lead").alias("b"), F.struct("id", "n", "pos", "far", "root").alias("y"))
        last = lists.join(x, ["list", "a"]).where(F.col("apart") <= 1 - t + F.col("x.far") + F.col("_fb") + 1e-9).join(y, ["list", "b"]).where(
            (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") >= t * F.greatest("x.n", "y.n"))
            & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= (F.col("x.n") + F.col("y.n")) * (t / (1 + t)) - 1e-9)
            & (F.col("apart") <= 1 - t + F.col("x.far") + F.col("y.far") + 1e-9) & ((F.col("x.id") != F.col("a")) | (F.col("y.id") != F.col("b"))))
        last = last.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(0.0).alias("far")).distinct()
        last = stored(possible(last, bits, percent))
        if last.limit(1).count():
            roots = _roots(compare(last, docs, sets, width).where(_linked(percent)).select("a", "b"), roots)
    return rows.drop("bits").join(classed(sets, roots).select("set", F.col("root").alias("class")), "set", "left").select("doc_id", "n", "set", "class")


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included. A null or empty
    text, or one without words, has an empty set and is its own component. Rows with a null id
    take part by their class's smallest id but are not compared for others; such a row alone has
    a null component. Repeated rows each get their row; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows = stored(classes(docs, width, percent))
    smallest = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("_min"))
    return rows.join(smallest, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_min")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, columns unchanged, of which each component's smallest stays; one row of those that
    repeat its id. Rows with a null id stay."""
    kept = components(docs, width, percent).where("doc_id = component_id").select("doc_id").distinct()
    joined = docs.join(kept, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    turn = Window.partitionBy("doc_id").orderBy("text")
    one = joined.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")
    return one.unionByName(docs.where("doc_id IS NULL"))


#: The same components for DuckDB: all pairs that share a shingle, and the reach of their links.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = d.doc_id"""

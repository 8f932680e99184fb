"""Token ids in Re-Pair compressed shards.

Frequent pairs of neighbouring ids are repeatedly replaced by nonterminals. A block keeps its rules with
the length of each one's expansion, and where each document's symbols end, so that a document or a
range of ids is read without expanding the rest. Pairs never cross documents.

Layout of a block (all numbers little-endian): the magic ``RPR1``; four uint32: documents, rules, symbols, base;
then uint32 arrays: left and right symbol of each rule, expansion length of each rule, end of
each document in symbols, end of each document in ids, the symbols. Symbols below ``base`` are ids, others
rules. Spark writes the blocks as rows of a table, so task retries and lost executors leave no partial files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.bpe import codec
from timbrel.llm.common import arrow_map, utf8
from timbrel.session import materialise

c = F.col
MAGIC = b"RPR1"
END = 2  # closes every document
BLOCK_IDS = 1 << 20  # a block ends with the document that reaches this
LEAST = 24  # occurrences that make a pair frequent


SLOTS = 20  # bits of the hashed count that precedes the exact one


def _frequent(key: np.ndarray):
    """Frequent pairs with their counts, and which of the keys are among them: (pairs, counts, kept keys, pair index)."""
    among, some, slot = np.arange(len(key)), key, None
    if len(key) >> SLOTS - 4:
        # a cheap count over hashed keys first: few of the rare pairs reach the sort
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).view(np.int64)
        among = np.flatnonzero((np.bincount(slot, minlength=1 << SLOTS) >= LEAST)[slot])
        some, slot = key[among], slot[among]
    ranked = np.sort(some)
    edge = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, np.int64)
    n = np.diff(np.r_[edge, len(ranked)])
    pairs, counts = ranked[edge[n >= LEAST]], n[n >= LEAST]
    if not len(pairs):
        return pairs, counts, among[:0], among[:0]
    if slot is None:
        at = np.minimum(np.searchsorted(pairs, some), len(pairs) - 1)
    else:
        # most slots hold one frequent pair; only keys of the others are searched for
        number = np.zeros(1 << SLOTS, np.int32)
        number[(pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).view(np.int64)] = np.arange(len(pairs))
        at = number[slot].astype(np.int64)
        other = np.flatnonzero(pairs[at] != some)
        at[other] = np.minimum(np.searchsorted(pairs, some[other]), len(pairs) - 1)
    match = pairs[at] == some
    return pairs, counts, among[match], at[match]


def _in_order(places: np.ndarray, n: int) -> np.ndarray:
    """The distinct places below ``n``, ascending."""
    if len(places) < n >> 5:
        return np.unique(places)
    seen = np.zeros(n, bool)
    seen[places] = True
    return np.flatnonzero(seen)


def compress(documents: list[np.ndarray]) -> bytes:
    """One block of the documents' ids.

    A round looks only at places whose pair was frequent in the round before or holds a symbol made by it: any other
    pair was rare and has not become more frequent, and a new symbol occurs nowhere else. Symbols keep their
    places; ``after`` and ``before`` lead past those that went into others.
    """
    ends = np.cumsum([len(d) for d in documents], dtype=np.int64)
    x = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.int32)  # ids and rules of a block are below 2^31
    base = int(x.max(initial=0)) + 1
    last = np.zeros(len(x), bool)
    last[ends[ends > 0] - 1] = True
    after, before = np.arange(1, len(x) + 1, dtype=np.int32), np.arange(-1, len(x) - 1, dtype=np.int32)
    alive = np.ones(len(x), bool)
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    look = np.flatnonzero(~last)
    while len(look):
        key = x[look].astype(np.int64)
        key <<= 32
        key |= x[after[look]]
        pairs, counts, found, at = _frequent(key)
        if not len(pairs):
            break
        place = look[found].astype(np.int32)
        # of overlapping pairs the more frequent goes first; among equals every other one
        touch = np.zeros(len(place) + 1, bool)
        np.equal(place[1:], after[place[:-1]], out=touch[1:-1])
        index = np.arange(len(place), dtype=np.int32)
        begin = np.maximum.accumulate(np.where(touch[:-1], 0, index))
        rank = counts.astype(np.int32)[at] * 2 + ((index - begin) & 1 == 0)
        taken = np.ones(len(place), bool)
        taken[1:] = ~touch[1:-1] | (rank[1:] > rank[:-1])
        taken[:-1] &= ~touch[1:-1] | (rank[:-1] >= rank[1:])
        taken[1:] &= ~(touch[1:-1] & taken[:-1])
        used = np.bincount(at[taken], minlength=len(pairs)) >= 2
        if not used.any():
            break
        taken &= used[at]
        number = (np.cumsum(used) - 1 + base + len(rules)).astype(np.int32)
        here, at = place[taken], at[taken]
        made = np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], axis=1)
        gone = after[here]
        x[here] = number[at]
        last[here] = last[gone]
        alive[gone] = False
        follows = after[gone]
        after[here] = follows
        inner = follows < len(x)
        before[follows[inner]] = here[inner]
        look = _in_order(np.concatenate([place, here, before[here[before[here] >= 0]]]), len(x))
        look = look[alive[look] & ~last[look]]
        size = lambda s: np.where(s < base, 1, lengths[np.maximum(s - base, 0)] if len(lengths) else 1)
        lengths = np.r_[lengths, size(made[:, 0]) + size(made[:, 1])]
        rules = np.vstack([rules, made])
    x, last = x[alive], last[alive]
    closing = np.cumsum(last)  # empty documents end where the one before them ends
    filled = np.searchsorted(closing, np.cumsum([len(d) > 0 for d in documents])) + 1
    symbol_ends = np.where(np.cumsum([len(d) > 0 for d in documents]) > 0, filled, 0)
    head = np.array([len(documents), len(rules), len(x), base], "<u4")
    return MAGIC + b"".join(
        np.asarray(p).astype("<u4").tobytes() for p in (head, rules[:, 0], rules[:, 1], lengths, symbol_ends, ends, x))


class Block:
    """Reads a block. Memory beyond the block itself follows what is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair block")
        n = np.frombuffer(data, "<u4", offset=4)
        self.documents, rules, symbols, self.base = map(int, n[:4])
        parts = np.split(n[4:], np.cumsum([rules, rules, rules, self.documents, self.documents]))
        self.left, self.right, self.lengths, self.symbol_ends, self.ends, self.symbols = parts
        if len(self.symbols) != symbols:
            raise ValueError("the block is cut short")

    def _expand(self, s: np.ndarray) -> np.ndarray:
        while len(at := np.flatnonzero(s >= self.base)):
            width = np.ones(len(s), np.int64)
            width[at] = 2
            where = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.uint32)
            out[where] = s
            rule = s[at] - self.base
            out[where[at]], out[where[at] + 1] = self.left[rule], self.right[rule]
            s = out
        return s

    def _bounds(self, i: int) -> tuple[int, int]:
        return (int(self.symbol_ends[i - 1]) if i else 0), int(self.symbol_ends[i])

    def document(self, i: int) -> np.ndarray:
        lo, hi = self._bounds(i)
        return self._expand(self.symbols[lo:hi])

    def all_documents(self) -> list[np.ndarray]:
        """Every document, from one expansion of the whole block."""
        ids = self._expand(self.symbols)
        return np.split(ids, self.ends[:-1].astype(np.int64)) if self.documents else []

    def read(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``: whole symbols are skipped by their expansion lengths."""
        lo, hi = self._bounds(i)
        s = self.symbols[lo:hi]
        size = np.ones(len(s), np.int64)
        rule = s >= self.base
        size[rule] = self.lengths[s[rule] - self.base]
        end = np.cumsum(size)
        a = int(np.searchsorted(end, start, "right"))
        b = int(np.searchsorted(end, stop, "left")) + 1
        before = int(end[a - 1]) if a else 0
        return self._expand(s[a:b])[start - before : max(stop, start) - before]


BLOCKS = "shard int, part int, start_in_shard long, n_ids long, doc_ids array<{kind}>, data binary"


def write(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS,
    shard_bytes: int = 24 << 20,
) -> DataFrame:
    """Encodes texts, closes each by the end id, and writes the blocks; returns the written table.

    Shards are ranges of doc_id; ids that repeat are ordered by text, nulls come first. The number of
    shards follows the bytes of text, so each has about ``shard_bytes``. A null or empty text has the end
    id alone. Columns: shard, part, start_in_shard, n_ids, doc_ids, data.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ("doc_id", "salt")
    placed = (
        rows.withColumn("salt", F.xxhash64("text")).repartitionByRange(max(1, round(total / shard_bytes)), *order)
        .sortWithinPartitions(*order, "text").drop("salt")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = codec(vocabulary), TaskContext.get().partitionId()
        end, waiting, names, count, start, part = END.to_bytes(4, "little"), [], [], 0, 0, 0

        def block():
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()),
                "start_in_shard": pa.array([start], pa.int64()), "n_ids": pa.array([count], pa.int64()),
                "doc_ids": pa.array([[x.as_py() for x in names]], pa.list_(id_type)), "data": pa.array([compress(waiting)], pa.binary()),
            })

        for b in batches:
            id_type = b[0].type
            texts = [t.decode("utf-8", "replace") for t in b[1].to_pylist()]
            for name, data in zip(b[0], coder.encode_all(texts)):
                ids = np.frombuffer(data + end, "<u4")
                waiting.append(ids)
                names.append(name)
                count += len(ids)
                if count >= block_ids:
                    yield block()
                    start, part = start + count, part + 1
                    waiting, names, count = [], [], 0
        if waiting:
            yield block()

    return materialise(arrow_map(placed, run, BLOCKS.format(kind=kind)), "token-shards")


def read(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids per document, from written blocks.

    ``start`` counts the ids of all documents before, from one total per shard.
    """
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard: a few thousand for a thousand executors, and two numbers each
    before = [(r.shard, r.n) for r in shards.orderBy("shard").toLocalIterator()]
    starts = dict(zip([s for s, _ in before], np.cumsum([0, *(n for _, n in before)]).tolist()))
    shared = blocks.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, offset, names, data in zip(b[0].to_pylist(), b[1].to_pylist(), b[2], b[3].to_pylist()):
                block = Block(data)
                n = np.diff(np.r_[0, block.ends.astype(np.int64)])
                start = shared.value[shard] + offset + np.r_[0, np.cumsum(n)[:-1]]
                every = block.all_documents()
                for lo in range(0, block.documents, 500):
                    hi = min(block.documents, lo + 500)
                    ids = every[lo:hi]
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    columns = [names.values.slice(lo, hi - lo), pa.array(start[lo:hi], pa.int64()), pa.array(n[lo:hi], pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
                        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), flat))
                    yield pa.RecordBatch.from_arrays(columns, names=fields[: len(columns)])

    rows = blocks.select("shard", "start_in_shard", "doc_ids", "data")
    fields = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    return arrow_map(rows, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)

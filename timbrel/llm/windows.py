"""Substring dedup by level-wise doubling: windows of words that repeat are extended to twice their length.

A window of ``length`` words that starts twice holds shorter windows that start twice. So the search begins with
windows of a quarter of the length, of which every long window is represented by one, the one of least hash:
equal windows choose the same. Those that occur once alone are told to their texts, which try windows of twice
the length only around the others, and of the full length only where all shorter ones survive. A level in
which nothing survives leaves nothing for the next.

Nobody collects the places of a window: a level's table has one row per hash, with its first and last place, added
up before the shuffle. What goes back to a text are the places that are alone, and at the full length the first
places; all other places that it tried are repeats. Equal texts are tried once, for the smallest id that has them;
the others repeat all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, utf8, written
from timbrel.llm.periods import mix

c = F.col
LENGTH = 20  # words
BATCH_BYTES = 2 << 20  # texts are worked on together up to so many bytes; a longer one alone
U = np.uint64
REACH = 64  # bytes of a word that the table below covers; longer words are hashed one by one
BYTE_KEYS = mix(np.arange(REACH * 256, dtype=U), np.full(REACH * 256, 0x5851F42D4C957F2D, U))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of several texts: where they stand in ``data``, whose they are, and a 64-bit key of each."""

    def __init__(self, texts: pa.Array):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        self.data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held is not None and len(ends) else np.zeros(0, np.uint8)
        edges = ends - ends[0]
        ink = ~BLANK[self.data]
        before = np.zeros(len(ink), bool)
        before[1:] = ink[:-1]
        inner = edges[(edges > 0) & (edges < len(ink))]
        before[inner] = False
        after = np.zeros(len(ink), bool)
        after[:-1] = ink[1:]
        after[inner - 1] = False
        self.begin, self.end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
        self.doc = np.searchsorted(edges, self.begin, "right") - 1
        self.sizes = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.stops = np.cumsum(self.sizes)
        self.starts = self.stops - self.sizes
        self.ink, self.long = ink, self.end - self.begin
        self.keys = self._keys()

    def _keys(self) -> np.ndarray:
        at = np.flatnonzero(self.ink)
        if not len(at):
            return np.zeros(0, U)
        first = np.cumsum(self.long) - self.long
        place = at - np.repeat(self.begin, self.long)
        keys = np.add.reduceat(BYTE_KEYS[(place % REACH) * 256 + self.data[at]], first)
        for i in np.flatnonzero(self.long > REACH).tolist():
            keys[i] = xxhash.xxh3_64_intdigest(self.data[self.begin[i] : self.end[i]].tobytes())
        return keys

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Per text the kept words with one space between them."""
        kept = np.flatnonzero(keep)
        doc = self.doc[kept]
        inner = np.zeros(len(kept), bool)
        inner[:-1] = doc[1:] == doc[:-1]  # another kept word of the text follows, so a blank does
        data, take = self.data.copy(), np.zeros(len(self.data), bool)
        take[np.flatnonzero(self.ink)] = np.repeat(keep, self.long)
        gaps = self.end[kept[inner]]
        data[gaps], take[gaps] = 32, True
        sizes = np.bincount(doc, self.long[kept] + inner, minlength=len(self.sizes)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[take])])


def strings(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``k`` words from every position on."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h, size, out, at = mix(words, words + U(seed)), 1, None, 0
    while True:
        if k & size:
            part = h[at : at + n]
            out, at = part if out is None else mix(out, part), at + size
        if 2 * size > k:
            return out
        h, size = mix(h[:-size], h[size:]), 2 * size


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """The position of the least hash, the leftmost of equal ones, in every window of ``width`` neighbours."""
    at, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at, size = np.where(h[left] <= h[right], left, right), size + step
    return at


class Batch(Words):
    """Several texts' words, and the windows that each level tries."""

    def __init__(self, texts: pa.Array, length: int):
        super().__init__(texts)
        self.short, self.half, self.length = length // 4, length // 2, length

    def marked(self, lists: pa.Array) -> np.ndarray:
        """The listed places of every text as marks on all positions."""
        out = np.zeros(len(self.keys) + 1, bool)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        out[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(self.starts, n)] = True
        return out

    def tried(self, gone: list[pa.Array]) -> np.ndarray:
        """Positions of the windows that the level after ``gone`` has to look at."""
        at = np.arange(max(0, len(self.keys) - self.length + 1))
        at = at[at + self.length <= self.stops[self.doc[at]]]
        if not len(at):
            return at
        chosen = least_in(strings(self.keys, self.short), self.length - self.short + 1)[at]
        if not gone:
            new = np.zeros(len(self.keys), bool)
            new[chosen] = True
            return np.flatnonzero(new)
        alive = ~self.marked(gone[0])[chosen]
        at, chosen = at[alive], chosen[alive]
        # twice the length: from the chosen window on, and up to its end
        right, left = chosen, chosen - self.short
        has_right, has_left = right + self.half <= at + self.length, left >= at
        if len(gone) == 1:
            new = np.zeros(len(self.keys), bool)
            new[right[has_right]] = new[left[has_left]] = True
            return np.flatnonzero(new)
        alive = ~self.marked(gone[1])
        return at[(alive[right] | ~has_right) & (alive[left] | ~has_left)]


def _batches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    for b in batches:
        size, lo = 0, 0
        for i, n in enumerate(pa.compute.binary_length(b["text"]).to_pylist()):
            if i > lo and size + n > BATCH_BYTES:
                yield b.slice(lo, i - lo), Batch(b["text"].slice(lo, i - lo), length)
                size, lo = 0, i
            size += n
        if lo < b.num_rows:
            yield b.slice(lo), Batch(b["text"].slice(lo), length)


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, print, size, text: a text is known by its digest and number of bytes."""
    body = utf8(c(text))
    return docs.select(c(doc_id).alias("id"), F.xxhash64(body).alias("print"), F.octet_length(body).alias("size"), body.alias("text"))


def _told(rows: DataFrame, owners: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``rows`` with ``owns`` (whether the text is tried under this id) and gone0, gone1, ...: what the levels told the text."""
    said = owners.withColumns({"level": F.lit(-1), "places": F.lit(None).cast("array<int>")})
    for i, x in enumerate(levels):
        said = said.unionByName(x.withColumn("level", F.lit(i)), allowMissingColumns=True)
    pick = lambda i, x: F.first(F.when(c("level") == i, c(x)), ignorenulls=True)
    said = said.groupBy(c("print").alias("__print"), c("size").alias("__size")).agg(
        pick(-1, "owner").alias("owner"), *(pick(i, "places").alias(f"gone{i}") for i in range(len(levels))))
    found = rows.join(said, (c("print") == c("__print")) & (c("size") == c("__size")))
    return found.withColumn("owns", c("id").eqNullSafe(c("owner.id"))).drop("__print", "__size", "owner")


def repeated_places(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, print, size, text, owns, gone0, gone1, gone2: every row with what the levels told its text."""
    if length % 4 or length < 4:
        raise ValueError("the length must be a multiple of four words")
    rows = _documents(docs, doc_id, text)
    kind = rows.schema["id"].dataType.simpleString()
    # a null id comes before all others
    owners = written(rows.groupBy("print", "size").agg(F.min(F.struct("id")).alias("owner")), "owners")
    levels: list[DataFrame] = []
    for k in (length // 4, length // 2, length):
        names = [f"gone{i}" for i in range(len(levels))]

        def emit(batches: Iterator[pa.RecordBatch], k=k, names=names) -> Iterator[pa.RecordBatch]:
            for b, words in _batches(batches, length):
                at = words.tried([b[x] for x in names])
                doc = pa.array(words.doc[at])
                yield pa.RecordBatch.from_arrays(
                    [*(b[x].take(doc) for x in ("id", "print", "size")), pa.array((at - words.starts[words.doc[at]]).astype(np.int32)),
                     pa.array(strings(words.keys, k)[at].view(np.int64)),
                     pa.array(strings(words.keys, k, 1)[at].view(np.int64) if k == length else np.zeros(len(at), np.int64))],
                    names=["id", "print", "size", "at", "key", "more"])

        source = _told(rows, owners, levels).where("owns").drop("owns") if levels else rows
        places = arrow_map(source, emit, f"id {kind}, print long, size int, at int, key long, more long")
        if k < length:  # a hash whose places agree in everything is at one place alone, of one text
            place = ("print", "size", "at")
            both = places.groupBy("key").agg(*(F.min(x).alias(x) for x in place), *(F.max(x).alias(f"__{x}") for x in place))
            alone = both.where((c("print") == c("__print")) & (c("size") == c("__size")) & (c("at") == c("__at")))
        else:  # 128 bits decide
            alone = places.groupBy("key", "more").agg(F.min(F.struct("id", "print", "size", "at")).alias("first")).select("first.*")
        levels.append(written(alone.groupBy("print", "size").agg(F.collect_list("at").alias("places")), f"level{k}"))
    return _told(rows, owners, levels)


def drop_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: one row per row of ``docs``, without the words of repeated windows.

    Words stand between ASCII white space and are compared byte by byte. A word goes if a window of
    ``length`` words that covers it also starts earlier: in a smaller doc_id, or earlier in the same text. Rows that
    share an id but not the text come in an order fixed by digests of the texts; rows equal in both are one document
    and get the same answer; a null id comes before all others. Null and empty texts have no words, texts
    shorter than a window lose none. ``kept`` has the other words, joined by one space. Other columns are not looked at;
    no rows give no rows; a text of any length is worked on whole. Windows are told apart by 128-bit hashes, texts by
    64 bits and their length.
    """
    rows = repeated_places(docs, length, doc_id, text)
    kind = rows.schema["id"].dataType.simpleString()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _batches(batches, length):
            at = words.tried([b["gone0"], b["gone1"]])
            at = at[~words.marked(b["gone2"])[at]]
            edge = np.zeros(len(words.keys) + 1, np.int64)
            edge[at] += 1
            np.subtract.at(edge, at + length, 1)
            copy = ~b["owns"].to_numpy(zero_copy_only=False) & (words.sizes >= length)
            gone = (np.cumsum(edge[:-1]) > 0) | copy[words.doc]
            removed = np.bincount(words.doc[gone], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(words.sizes), pa.array(removed.astype(np.int64)), words.joined(~gone)],
                names=["doc_id", "n_words", "n_removed", "kept"])

    found = arrow_map(rows, answer, f"doc_id {kind}, n_words long, n_removed long, kept binary")
    return found.withColumn("kept", c("kept").cast("string"))

"""Alignment of two tokenizers by the spans of their tokens.

A byte-level BPE (A) reads a space and the text, a sentencepiece model (B) reads the text and adds that space
itself. A's tokens are placed by their bytes. The spans of B's proto are coarse cuts: they say which
tokens stand alone on a stretch of text. Where several tokens share characters - byte-fallback tokens -
the decoded bytes of the tokens place the cuts inside. Tokens whose byte ranges overlap are
linked, and byte offsets where tokens of both end cut a text into groups.

Texts are read in segments at whose edges both tokenizers are known to cut: before spaces that follow no other
white space. Groups and links therefore stay inside a segment, and one that comes again is not aligned again.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from timbrel.llm.bpe import SPACES, WHOLE, byte_letters, codec
from timbrel.llm.common import arrow_map, utf8
from timbrel.session import materialise

c = F.col
CACHED = 120_000  # segments after which a worker's store begins a new generation; it keeps two, about 80 MB
CACHED_LENGTH = 48
BATCH_BYTES = 4 << 20  # texts are aligned together up to so many bytes; a longer one alone
FREQUENT = 500_000  # pairs that at most are broadcast: those with at least 1 / FREQUENT of all links
B_BITS = 15  # ids of B in a pair's number
OTHER_SPACES = SPACES.replace(" ", "")
FIELDS_OF_PIECE = attrgetter("id", "begin", "end")
BEFORE_BLANK = [x + " " for x in OTHER_SPACES]
SEGMENTS = re.compile(f" +[^ ]*(?:(?<=[{OTHER_SPACES}]) +[^ ]*)*")


def segmented(text: str) -> list[str]:
    """The segments of a text that begins with a blank, each without its first blank."""
    if "  " in text or any(x in text for x in BEFORE_BLANK):
        return [s[1:] for s in SEGMENTS.findall(text)]
    return text.split(" ")[1:]


def token_ends(raw: bytes, begin: np.ndarray, end: np.ndarray, tokens: list[bytes]) -> np.ndarray | None:
    """Where each token ends in ``raw``; None if the tokens' bytes are not ``raw``.

    ``begin`` and ``end`` are the byte ranges that a tokenizer says its tokens cover. A token whose range meets no
    other's ends where the range does; tokens of overlapping or empty ranges are placed by their own bytes.
    """
    if b"".join(tokens) != raw:
        return None
    own = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    alone = end > begin
    alone[1:] &= begin[1:] >= np.maximum.accumulate(end)[:-1]
    alone[:-1] &= np.minimum.accumulate(begin[::-1])[::-1][1:] >= end[:-1]
    ends = np.where(alone, end, own)
    return ends if np.array_equal(ends, own) else own  # where ranges do not fit the bytes, the bytes decide


class Side:
    """A tokenizer with the bytes of its tokens."""

    bytes: dict[int, bytes] | list[bytes]

    def encode(self, text: str, raw: bytes, longest: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and ends of the tokens of ``text``, None where their bytes are not ``raw``; ``longest`` bounds its segments."""
        ids, begin, end = self.tokens(text)
        ends = token_ends(raw, begin, end, [self.bytes[i] for i in ids.tolist()])
        return None if ends is None else (ids, ends)


class ByteLevel(Side):
    """A byte-level BPE file. Its tokens are byte strings of the vocabulary, so each one's own bytes place it.

    The codec of ``bpe`` gives the ids of the plain form that it knows, for segments up to ``WHOLE`` characters; for
    others, and other forms, the library does, with spans by its offsets.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        cut = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and known == {k: cut.get(k) for k in known}
        self.join = codec(path).join_whole if plain else None
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_letters()
        self.bytes = {
            i: bytes(letters[x] for x in t) if all(x in letters for x in t) else t.encode()
            for t, i in self.library.get_vocab().items()}

    def encode(self, text: str, raw: bytes, longest: int) -> tuple[np.ndarray, np.ndarray] | None:
        if self.join is None or longest > WHOLE:
            return super().encode(text, raw, longest)
        ids = self.join(text)
        tokens = [self.bytes[i] for i in ids]
        if b"".join(tokens) != raw:
            return None
        return np.array(ids, np.int64), np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.library.encode(text, add_special_tokens=False)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
        if not text.isascii():  # characters to bytes
            code = np.frombuffer(text.encode("utf-32-le"), "<u4")
            spans = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])[spans]
        return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]


class Pieces(Side):
    """A sentencepiece file; spans are those of the library's proto."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("▁" in x.lstrip("▁") for x in names) or len(names) > 1 << B_BITS:
            raise ValueError("pieces reach beyond the next space, or are too many")
        self.bytes = [
            bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace("▁", " ").encode()
            for i, x in enumerate(names)]
        self.blank = self.library.piece_to_id("▁")

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if text == " ":  # the model adds no space to an empty text
            return np.array([self.blank]), np.array([0]), np.array([1])
        # the first space is the one that the model adds itself; its spans count the text's bytes without it
        proto = self.library.encode(text[1:], return_type="proto", num_threads=1).pieces
        found = np.fromiter(chain.from_iterable(map(FIELDS_OF_PIECE, proto)), np.int64).reshape(-1, 3)
        begin, end = found[:, 1] + 1, found[:, 2] + 1
        begin[0] = 0
        return found[:, 0], begin, end


class Written:
    """Decimal ids with the mark that follows them, for both sides."""

    def __init__(self, ids: int = 1 << 16):
        digits = [str(i) for i in range(ids)]
        self.size, self.table = ids, [d + mark for mark in (",", "|", ";") for d in digits]

    def tokens(self, ids: np.ndarray, marks: np.ndarray) -> list[str]:
        return [self.table[i] for i in (marks * self.size + ids).tolist()]


@lru_cache(maxsize=1)
def written() -> Written:
    return Written()


# numbers of A and B tokens in one number, the groups' text, and the links' pairs as int32
Entry = tuple[int, str, bytes] | None
HALF = 31


def entries(a: Side, b: Side, segments: list[str]) -> list[Entry]:
    """The alignment of each segment, None where tokens' bytes differ from it. Segments are encoded in one text.

    The tokens of both sides end at ascending offsets, and every stretch between two neighbouring ends lies in one token
    of each side, which is one link.
    """
    if not segments:
        return []
    parts = [s.encode() for s in segments]
    text, raw = "".join(segments), b"".join(parts)
    longest = max(map(len, segments))
    found = [a.encode(text, raw, longest), b.encode(text, raw, longest)]
    stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    fits = lambda x: x is not None and np.isin(stops, x[1], assume_unique=True).all()
    if not all(map(fits, found)):  # some segment differs: it is looked for
        return [e for s in segments for e in entries(a, b, [s])] if len(segments) > 1 else [None]
    (ids_a, ends_a), (ids_b, ends_b) = found
    every = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    again = np.zeros(len(every), bool)
    again[1:] = every[1:] == every[:-1]
    ends, both = every[~again], every[again]
    links = (ids_a[np.searchsorted(ends_a, ends)] << B_BITS | ids_b[np.searchsorted(ends_b, ends)]).astype("<i4").tobytes()
    # tokens by group, A before B, each with the mark after it
    marks_a, marks_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    marks_a[np.searchsorted(ends_a, both)], marks_b[np.searchsorted(ends_b, both)] = 1, 2
    order = np.argsort(np.concatenate([np.searchsorted(both, ends_a) * 2, np.searchsorted(both, ends_b) * 2 + 1]), kind="stable")
    tokens = written().tokens(np.concatenate([ids_a, ids_b])[order], np.concatenate([marks_a, marks_b])[order])
    to_a, to_b, to_link = (np.searchsorted(x, stops, "right") for x in (ends_a, ends_b, ends))
    counts = (np.diff(to_a, prepend=0) << HALF | np.diff(to_b, prepend=0)).tolist()
    edges, bytes_to = [0, *(to_a + to_b).tolist()], [0, *(to_link * 4).tolist()]
    return [
        (n, "".join(tokens[edges[k] : edges[k + 1]])[:-1], links[bytes_to[k] : bytes_to[k + 1]])
        for k, n in enumerate(counts)]


class Store:
    """What segments align to. Segments of late are kept: those of two generations, of ``CACHED`` and a batch each."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.young, self.old = a, b, {}, {}

    def align(self, texts: list[str]) -> list[list[Entry]]:
        """The entries of every text; each text begins with the space that belongs to it."""
        lists = [segmented(t) for t in texts]
        segments = set(chain.from_iterable(lists))
        again = segments & self.old.keys()
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        new = segments - self.young.keys()
        # white space at a segment's end would run on into the next one; the letter for a space is not the text's own
        single = [s for s in new if s[-1:] in SPACES or "▁" in s]
        joint = list(new.difference(single))
        known = dict(zip(joint, entries(self.a, self.b, [" " + s for s in joint])))
        known |= {s: entries(self.a, self.b, [" " + s])[0] for s in single}
        self.young |= known
        found = [list(map(self.young.__getitem__, x)) for x in lists]
        for s in known:
            if len(s) > CACHED_LENGTH:
                del self.young[s]
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        return found


@lru_cache(maxsize=2)
def store(a: str, b: str) -> Store:
    return Store(ByteLevel(a), Pieces(b))


def summed(lists: list[list[Entry]]) -> tuple:
    """Per text: numbers of A and B tokens, groups and links, the groups' text, distinct pairs; then all pairs and their numbers of links."""
    columns = [((), (), ()) if not x or None in x else tuple(zip(*x)) for x in lists]
    counts = [sum(n) for n, _, _ in columns]
    groups = [";".join(g) for _, g, _ in columns]
    flat = [b"".join(x) for _, _, x in columns]
    n_links = np.array([len(x) // 4 for x in flat], np.int64)
    links = np.repeat(np.arange(len(lists)), n_links) << 32 | np.frombuffer(b"".join(flat), "<i4").astype(np.int64)
    links.sort()
    first = np.flatnonzero(np.concatenate([[True], links[1:] != links[:-1]])) if len(links) else np.zeros(0, np.int64)
    key, times = links[first], np.diff(first, append=len(links))
    n_a, n_b = [n >> HALF for n in counts], [n & ((1 << HALF) - 1) for n in counts]
    n_groups = [g.count(";") + 1 if g else 0 for g in groups]
    return n_a, n_b, n_groups, n_links, groups, np.bincount(key >> 32, minlength=len(lists)), key & 0xFFFFFFFF, times


FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<int>"


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times: one row per row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of both sides, group by group. ``pairs`` are the distinct linked ids, a
    shifted by ``B_BITS`` with b below, and ``times`` their numbers of links in the text. Null and empty texts, and texts
    whose tokens' bytes are not a space and the text on both sides, have no tokens: zeros and empty lists. Rows
    that repeat an id or a text are each answered; other columns are not looked at; texts are read whole,
    whatever their length; no rows give no rows. The files must be readable on every executor.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def answer(ids: list, texts: list[str]) -> pa.RecordBatch:
        n_a, n_b, n_groups, n_links, groups, sizes, key, times = summed(store(a, b).align([t and " " + t for t in texts]))
        ends = pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key, times)]
        numbers = [pa.array(np.asarray(x, np.int64)) for x in (n_a, n_b, n_groups, n_links)]
        return pa.RecordBatch.from_arrays(
            [ids, *numbers, pa.array(groups, pa.string()), *lists],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # no cycles are made here, and the collector would walk all kept segments over and over
        for x in batches:
            texts, size, lo = [], 0, 0
            for i, t in enumerate(x[1].to_pylist()):
                if texts and size + len(t) > BATCH_BYTES:
                    yield answer(x[0][lo:i], texts)
                    texts, size, lo = [], 0, i
                texts.append(t.decode("utf-8", "replace"))
                size += len(t)
            if texts:
                yield answer(x[0][lo:], texts)

    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, {FIELDS}")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n, best: the links of every pair of ids in all texts, and whether no pair with that B id has more."""
    counts = materialise(links.groupBy("pair").agg(F.sum("times").alias("n")), "pairs")
    b = c("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row per id of B: 2^B_BITS at most
    return counts.join(F.broadcast(top), b == c("b")).select("pair", "n", (c("n") == c("most")).alias("best"))


def link_strength(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text",
                  digest: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """What ``align`` gives (through ``digest``), and n_best, count_sum: how well corpus-wide counts bear a text's links out.

    ``n_best`` counts the links whose pair is the most frequent one of its B id, ties included, ``count_sum`` adds up the
    counts of all links' pairs. Counts cover every row of ``docs``. Pairs that hold 1 / FREQUENT of all links or
    more are broadcast, FREQUENT rows at most; all others meet their counts by a shuffle, and none of
    them is hot. ``digest`` may reduce the columns before they are written. Odd rows as in ``align``.
    """
    row = F.monotonically_increasing_id()
    found = materialise(digest(align(docs, a, b, doc_id, text)).withColumn("__row", row), "aligned")
    links = found.select("__row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "__row", c("x.pairs").alias("pair"), c("x.times").alias("times"))
    counts = materialise(pair_counts(links), "counts")
    least = F.lit(counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    often = links.join(F.broadcast(counts.where(c("n") >= least)), "pair", "left")
    gains = (c("times") * c("best").cast("long"), c("times") * c("n"))
    near = often.where("n is not null").select("__row", *gains)
    far = often.where("n is null").select("__row", "pair", "times").join(
        counts.where(c("n") < least).hint("shuffle_hash"), "pair").select("__row", *gains)
    parts = [x.toDF("__row", "n_best", "count_sum").groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")) for x in (near, far)]
    sums = parts[0].unionByName(parts[1]).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.join(sums, "__row", "left").drop("__row")
    return out.withColumns({x: F.coalesce(x, F.lit(0).cast("long")) for x in ("n_best", "count_sum")})

"""Byte-level BPE by forced-boundary splitting.

A merge always yields a token that holds the byte pair where its parts met. A pair of neighbouring
bytes that occurs inside no token of the vocabulary can therefore never be merged across: it
marks a certain cut. Texts are cut before white space, then by the tokenizer's own pattern, then
at all such pairs; the fragments are encoded independently and concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, utf8

c = F.col

# The published pattern of this tokenizer, and the characters it takes for white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CACHED = 100_000  # pieces that each of the two caches of a worker keeps, about 15 MB; beyond it the cache starts anew
CACHED_LENGTH = 48
KNOWN = 300_000  # words of which a worker that encodes batches keeps the ids, besides those of one batch; about 45 MB
WHOLE = 200_000  # characters of a text that the library joins at once; its pattern keeps a state for each one of a run


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Kept(dict):
    """A dictionary that fills itself by ``make`` and starts anew when it is full."""

    def __init__(self, make, most: int = CACHED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes and decodes by the vocabulary file at ``path``. Ids travel as little-endian uint32 bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[x] for x in s)
        vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.inside = {pair for token in vocab for pair in zip(token, token[1:])}
        # ids in order of merging are ranks, and then a library can join the bytes of a fragment
        made = [i for _, i in self.merges.values()]
        ranks = {k: v for k, v in vocab.items() if v not in self.special.values()}
        in_order = made == sorted(set(made)) and min(made, default=256) > max(self.byte_ids)
        joiner = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order else None
        self.join = joiner._core_bpe.encode_single_piece if joiner else None
        self.join_whole = joiner._core_bpe.encode_ordinary if joiner else None
        # tokens that begin with white space, by id: a piece's first token does, and no other one of it
        self.begins = np.zeros(max(self.tokens, default=0) + 1, bool)
        self.begins[[i for i, t in self.tokens.items() if t[:1] in (b" ", b"\n")]] = True
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.other_spaces = [x for x in SPACES if x not in " \n"]
        self.runs = [*self.other_spaces, "  ", " \n", "\n ", "\n\n"]
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.after_blank = Kept(lambda s: self._piece(s if s[:1] == "\n" else " " + s))
        self.pieces = Kept(self._piece)
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of the known words

    def forced_cuts(self, raw: bytes) -> list[bytes]:
        """``raw`` cut wherever two neighbouring bytes occur inside no token."""
        at = [i for i, pair in enumerate(zip(raw, raw[1:]), 1) if pair not in self.inside]
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])] if at else [raw]

    def _merge(self, raw: bytes) -> list[int]:
        """Joins the pair of lowest rank, the leftmost first, until none is left."""
        return self.join(raw) if self.join else self._merge_pairs(raw)

    def _merge_pairs(self, raw: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in raw]
        merges = self.merges
        n = len(ids)
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (p := (ids[i], ids[k])) in merges:
                    heapq.heappush(heap, (merges[p][0], i, *p))
            if (h := left[i]) >= 0 and (p := (ids[h], ids[i])) in merges:
                heapq.heappush(heap, (merges[p][0], h, *p))
        return [x for x in ids if x >= 0]

    def _piece(self, text: str) -> bytes:
        words = (text,) if text.isalpha() or text[:1] == " " and text[1:].isalpha() else self.pattern.findall(text)
        ids = []
        for word in words:
            for fragment in self.forced_cuts(word.encode("utf-8")):
                ids += self._merge(fragment)
        return array("I", ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if not any(x in text for x in self.other_spaces):
            first, *rest = text.replace("\n", " \n").split(" ")
            if first not in ("", "\n") and "" not in rest and "\n" not in rest:  # no runs of white space
                return self.pieces[first] + b"".join(map(self.after_blank.__getitem__, rest))
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.specials is None or not self.specials.search(text):
            return self._plain(text)
        return b"".join(
            np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x)
            for x in self.specials.split(text) if x
        )

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that follow a blank (or begin with a line break), all new ones encoded as one text.

        The pattern never crosses into white space, so a word's ids are the same in any text that goes on with white space.
        """
        if len(self.known) > KNOWN or self.held > KNOWN * 16:
            self.known, self.held = {}, 0
        made = list(map(self.known.get, words))
        at = [i for i, x in enumerate(made) if x is None]
        if not at:
            return made
        new = [words[i] for i in at]
        joined = "".join([w if w[0] == "\n" else " " + w for w in new])
        ids = np.array(self.join_whole(joined), "<u4")
        raw = ids.tobytes()
        edges = [*(np.flatnonzero(self.begins[ids]) * 4).tolist(), len(raw)]
        self.held += len(joined)
        for i, w, x, y in zip(at, new, edges, edges[1:]):
            made[i] = self.known[w] = raw[x:y]
        return made

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of every text, new words of all texts encoded together where a library can join bytes.

        Only single blanks and line breaks are cut at; a text with other white space is joined whole, very long ones
        and ones with special tokens by ``encode``.
        """
        if not self.join_whole:
            return [self.encode(t) for t in texts]
        out, waiting, lines = [b""] * len(texts), [], []
        for k, text in enumerate(texts):
            if len(text) > WHOLE or self.specials is not None and self.specials.search(text):
                out[k] = self.encode(text)
            elif not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.runs):
                out[k] = np.array(self.join_whole(text), "<u4").tobytes()
            else:
                waiting.append(k)
                lines.append(text.replace("\n", " \n"))
        if not waiting:
            return out
        split = pc.split_pattern(pa.array(lines, pa.large_string()), " ")
        words, begin = split.flatten(), split.offsets.to_numpy()[:-1]
        # a word is looked up once a batch; its places hold numbers
        numbered = words.dictionary_encode()
        number, distinct = numbered.indices.to_numpy(), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        made = self._learn(distinct)
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[number]
        n[begin] = 0  # no blank precedes a text's first word
        ends = np.cumsum(n)
        places = np.repeat(starts[number] - ends + n, n) + np.arange(ends[-1])
        raw = np.frombuffer(b"".join(made), "<u4")[places].tobytes()
        edges = (np.r_[ends[begin], ends[-1]] * 4).tolist()
        for k, first, i, j in zip(waiting, words.take(pa.array(begin)).to_pylist(), edges, edges[1:]):
            out[k] = np.array(self.join_whole(first), "<u4").tobytes() + raw[i:j]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        get = self.tokens.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    return Codec(path)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``ids`` (array<int>) per row; a null or empty text has no ids.

    Rows stay as they are, repeated ones too, and an empty table gives an empty table. Texts of any
    length are encoded whole. ``vocabulary`` must be readable on every executor.
    """
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            ids = [coder.encode(t.decode("utf-8", "replace")) for t in b[-1].to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*keep, "ids"])

    rows = docs.select(*(c(f"`{k}`") for k in keep), utf8(c(text)).alias("__text"))
    return arrow_map(rows, run, f"{kinds}, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and the decoded ``text`` per row; null ids give the empty text."""
    kinds = ", ".join(f"`{k}` {tokens.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            texts = [coder.decode(np.asarray(x or [], "<u4").tobytes()) for x in b[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    rows = tokens.select(*(c(f"`{k}`") for k in keep), c(ids).alias("__ids"))
    return arrow_map(rows, run, f"{kinds}, text string")


def round_trip(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, encoding and decoding in one pass."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            n, left, right = [], [], []
            for t in b[1].to_pylist():
                ids = coder.encode(t.decode("utf-8", "replace"))
                n.append(len(ids) // 4)
                left.append(hashlib.sha256(ids).hexdigest())
                right.append(hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b[0], pa.array(n, pa.int64()), pa.array(left), pa.array(right)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, round_trips: the last says that decoding gives the text back."""
    kept = tuple(x for x in (doc_id, "lang", "source") if x in docs.columns)
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(vocabulary)
        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in b[-1].to_pylist()]
            ids = [coder.encode(t) for t in texts]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            same = [coder.decode(x) == t for x, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_())],
                names=[*kept, "ids", "n_tokens", "round_trips"])

    rows = docs.select(*(c(f"`{k}`") for k in kept), utf8(c(text)).alias("__text"))
    return arrow_map(rows, run, f"{kinds}, ids array<int>, n_tokens long, round_trips boolean")

"""Cross-entropy difference: matched bigram models of a target and of the background score each document.

Both models count every word and word pair of the whole corpus exactly, share one vocabulary and one
smoothing, so their losses on a token are comparable. Documents are dealt into chunks. Each chunk sorts the
keys of its distinct words and pairs, cuts them by key range and sends every range as one packed list of
keys and counts. What meets in a range is added up, and each chunk gets the sums of its own keys back without the
keys: in ascending order, as it has them itself. So a task holds one chunk, or one range, and what is gathered
grows with the corpus in chunks and in ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, utf8
from timbrel.llm.decontaminate import bounded
from timbrel.session import materialise

c = F.col
WORDS = 1 << 18  # kinds of words that the smoothing counts on at least; more if the corpus has more
CHUNK_BYTES = 8 << 20  # of text
RANGE_BYTES = 8 << 20  # of text whose keys meet in one range
ADDED = 0.05  # count that every word has beforehand
BACKOFF = 8.0  # pairs that a context takes from the unigram model


SUMS = pa.schema([
    ("range", pa.int64()), ("word", pa.bool_()), ("chunk", pa.int64()), ("kinds", pa.int64()), ("target", pa.int64()),
    ("every", pa.int64()), ("packed", pa.binary())])


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        if len(word) <= 40:
            if len(self) >= 500_000:
                self.clear()
            self[word] = value
        return value


_ids = Ids()


def tokens(data: bytes) -> np.ndarray:
    """64-bit keys of the A-Z-lower-cased words between ASCII spaces."""
    words = data.lower().split()
    return np.fromiter(map(_ids.__getitem__, words), np.int64, len(words))


def pairs(w: np.ndarray) -> np.ndarray:
    """64-bit keys of each word with the next."""
    mixed = w[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = ((mixed ^ mixed >> np.uint64(32)) + w[1:].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers of one length, compressed by byte planes."""
    planes = np.concatenate(columns).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, columns: int) -> np.ndarray:
    """The columns of ``pack`` as the rows of one array."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(columns, -1)


def sums_of(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sum of each of ``values`` over a key's rows."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _own(document: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the key of each place occurs in the place's document."""
    _, place, n = np.unique(document << 32 | at, return_inverse=True, return_counts=True)
    return n[place]


def token_losses(c1: np.ndarray, c2: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """-log P of each token given the one before, from the counts of the tokens and of the pairs they end."""
    p1 = (c1 + ADDED) / (total + ADDED * kinds)
    p = p1.copy()
    p[1:] = (np.minimum(c2, c1[:-1]) + BACKOFF * p1[1:]) / (c1[:-1] + BACKOFF)
    return -np.log(p)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference: one row per row of ``docs``.

    ``target`` has the doc_ids of the target; the background is every document. Losses are means per
    token, and ``difference`` = target_loss - background_loss: the lower, the more like the target. A
    document is scored without its own counts. Without tokens the losses are null and the difference 0.
    Null counts as empty; a null doc_id is never a target; without any target its model is flat;
    rows that repeat an id each get a row. A text longer than a chunk is a chunk of its own. Other columns are not
    looked at, whatever their names; no rows give no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = bounded(target.select(c(target.columns[0]).alias("__target")).where("__target is not null").distinct())
    rows = docs.join(chosen, c(doc_id) == c("__target"), "left").select(
        c(doc_id).alias("doc_id"), c("__target").isNotNull().alias("in_target"), utf8(c(text)).alias("text"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            chunks = []
            for n in pa.compute.binary_length(b[2]).to_pylist():
                if size and size + n > CHUNK_BYTES:
                    part, size = part + 1, 0
                size += n
                chunks.append(task << 32 | part)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *b.columns], names=["chunk", *b.schema.names])

    # written once, so that every later step sees the same chunks
    dealt = materialise(arrow_map(rows, deal, f"chunk long, doc_id {kind}, in_target boolean, text binary"), "chunks")

    size = dealt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    edges = np.array([-(1 << 63) + (k << 64) // ranges for k in range(ranges)], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, chosen = None, [], []

        def counted():
            for word, keys in ((True, ids), (False, [pairs(w) for w in ids])):
                every = np.concatenate([*keys, np.zeros(0, np.int64)])
                target = np.repeat(np.array(chosen, np.int64), [len(k) for k in keys])
                key, n, t = sums_of(every, np.ones(len(every), np.int64), target)
                at = np.searchsorted(edges, key, "right") - 1
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(key) else np.zeros(0, np.int64)
                stop = np.append(first[1:], len(key))
                packed = [pack(np.diff(key[i:j], prepend=np.int64(0)), t[i:j], n[i:j]) for i, j in zip(first, stop)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[first].astype(np.int64)), pa.array(np.full(len(first), word)),
                     pa.array(np.full(len(first), now, np.int64)), pa.array(packed, pa.binary())],
                    names=["range", "word", "chunk", "packed"])

        for b in batches:
            for chunk, x, t in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist()):
                if chunk != now:
                    if ids:
                        yield from counted()
                    now, ids, chosen = chunk, [], []
                ids.append(tokens(t))
                chosen.append(x)
        if ids:
            yield from counted()

    def add(sent: pa.Table) -> pa.Table:
        """Sums of a range: a row without chunk with the number of keys and both totals, then the sums that each chunk asked for."""
        which, word = sent["chunk"].to_numpy(), sent["word"][0].as_py()
        lists = [unpack(x, 3) for x in sent["packed"].to_pylist()]
        for x in lists:
            np.cumsum(x[0], out=x[0])
        key, target, every = sums_of(*(np.concatenate([x[k] for x in lists]) for k in range(3)))
        out = [(sent["range"][0].as_py(), word, None, len(key), int(target.sum()), int(every.sum()), None)]
        for chunk in np.unique(which):
            own = [lists[k][0] for k in np.flatnonzero(which == chunk)]
            # a chunk that several tasks read has sent a list from each
            at = np.searchsorted(key, own[0] if len(own) == 1 else np.unique(np.concatenate(own)))
            out.append((out[0][0], word, int(chunk), None, None, None, pack(target[at], every[at])))
        return pa.table([pa.array(v, t) for v, t in zip(zip(*out), SUMS.types)], schema=SUMS)

    sent = arrow_map(dealt.select("chunk", "in_target", "text"), count, "range long, word boolean, chunk long, packed binary")
    sums = materialise(sent.groupBy("range", "word").applyInArrow(
        add, "range long, word boolean, chunk long, kinds long, target long, every long, packed binary"), "sums")
    total = sums.where("chunk is null and word").agg(F.sum("kinds"), F.sum("target"), F.sum("every")).first()
    kinds, t_all, b_all = max(WORDS, total[0] or 0), total[1] or 0, total[2] or 0
    back = sums.where("chunk is not null").select("chunk", "word", "range", "packed")

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        ids = [tokens(t) for t in texts["text"].to_pylist()]
        n = np.array([len(w) for w in ids], np.int64)
        document = np.repeat(np.arange(len(ids)), n)
        later = np.ones(len(document), bool)  # all but the first word of each document
        later[(np.cumsum(n) - n)[n > 0]] = False
        counts = counts.sort_by("range")
        chosen = texts["in_target"].to_numpy()
        found = []
        for word, keys, of in ((True, ids, document), (False, [pairs(w) for w in ids], document[later])):
            key, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
            some = counts.filter(pa.compute.equal(counts["word"], word))["packed"].to_pylist()
            target, every = np.concatenate([unpack(x, 2) for x in some], axis=1) if some else np.zeros((2, 0), np.int64)
            if len(target) != len(key):
                raise ValueError("a chunk has other keys than it sent")
            own = _own(of, at)
            found.append((target[at] - own * chosen[of], every[at] - own))
        (t1, b1), (t2, b2) = found
        out, stops = [], np.cumsum(n).tolist()
        before = 0
        for k, (stop, m) in enumerate(zip(stops, n.tolist())):
            if not m:
                out.append((0, None, None, 0.0))
                continue
            one, two = slice(stop - m, stop), slice(before, before + m - 1)
            before += m - 1
            x = token_losses(t1[one], t2[two], t_all - m * int(chosen[k]), kinds).mean()
            y = token_losses(b1[one], b2[two], b_all - m, kinds).mean()
            out.append((m, float(x), float(y), float(x - y)))
        types = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        return pa.table([texts["doc_id"], *(pa.array(v, k) for v, k in zip(zip(*out), types))],
                        names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    return dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        score, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double")

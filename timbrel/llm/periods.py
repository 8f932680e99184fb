"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words that repeats with a period and holds it three times or more. For every
scale, periods between ``least`` and ``k`` words, the documents are cut into overlapping windows of hashed
``k``-word strings and each window's least hash is kept. A run repeats its windows at period distance, so
neighbouring minimizers of equal hash lie exactly one period apart there: such pairs are
seeds, extended to both sides by doubling hashes. Periods too short for windows are found by direct scans of
their lags.

Scales leave no gap. A window spans ``w + k - 1 <= 2 * least`` words, so inside three periods it fits together
with its copy one period on; and equal strings of ``k`` words, no shorter than the period, cannot lie closer
together than the smallest period. Hashes only propose: every run is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, prepare, utf8

c = F.col
SHORT = 8  # periods up to this many words are scanned directly
TIMES = 3  # periods that a run holds at least
LEAST = 24  # words that a run holds at least; no less than SHORT * TIMES
BATCH_WORDS = 1 << 19  # documents are worked on together up to so many words; a longer one alone
U = np.uint64


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash per pair of hashes, not linear in either."""
    x = (a ^ (a >> U(31))) * U(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        a, size = pick(a[:-size], a[size:]), 2 * size
    return pick(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


class Strings:
    """Hashes of all strings of 1, 2, 4, ... words of a sequence of word numbers."""

    def __init__(self, words: np.ndarray, longest: int):
        h = words.astype(U)
        self.levels = [mix(h, ~h)]
        while 1 << len(self.levels) <= min(longest, len(words)):
            h, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(mix(h[:-step], h[step:]))

    def of(self, k: int, end: int) -> np.ndarray:
        """Hashes of the ``k``-word strings that start and end before ``end``."""
        j = k.bit_length() - 1
        h, n = self.levels[j], max(0, end - k + 1)
        return h[:n] if 1 << j == k else mix(h[:n], h[k - (1 << j) :][:n])

    def extend(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest stretch around ``at`` whose words equal those ``lag`` further on: [start, end of the copy)."""
        left, right = at.copy(), at.copy()
        for j in range(len(self.levels) - 1, -1, -1):
            h, step = self.levels[j], 1 << j
            ok = right + lag < len(h)
            ok[ok] = h[right[ok]] == h[right[ok] + lag[ok]]
            right[ok] += step
            ok = left >= step
            ok[ok] = h[left[ok] - step] == h[left[ok] + lag[ok] - step]
            left[ok] -= step
        return left, right + lag


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least period, string length, window) per scale up to the largest period of ``longest`` words."""
    least = SHORT + 1
    while TIMES * least <= longest:
        k = least * 3 // 2
        yield least, k, 2 * least - k + 1
        least = k + 1


def _smaller_period(words: np.ndarray, lo: int, period: int) -> bool:
    """Whether the run from ``lo`` on with this period repeats already with a proper divisor of it."""
    rest, p = period, 2
    while rest > 1:
        if rest % p:
            p = p + 1 if p * p <= rest else rest
            continue
        while rest % p == 0:
            rest //= p
        q = period // p
        if np.array_equal(words[lo : lo + period], words[lo + q : lo + q + period]):
            return True
    return False


def lag_runs(words: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """[start, end) of all stretches of ``least`` words or more that repeat at distance ``q``."""
    same = np.zeros(max(0, len(words) - q) + 2, bool)
    same[1:-1] = words[q:] == words[: len(same) - 2]
    edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] >= least - q]
    return [(int(a), int(b) + q) for a, b in edge]


def runs_in(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per document all (start, length, period), in that order. Documents are arrays of word numbers from 0."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))  # longest first: scales see a prefix
    sizes = np.array([len(docs[i]) for i in order], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    total = int(ends[-1]) if len(docs) else 0
    words = np.empty(total, np.int64)
    for i, lo in zip(order, starts):
        words[lo : lo + len(docs[i])] = docs[i]
    words[ends - 1] = -1 - np.arange(len(docs))  # every document ends with a mark of its own
    found: set[tuple[int, int, int]] = set()  # (start, end, period) in ``words``

    def add(lo: int, hi: int, q: int) -> None:
        if hi - lo >= max(LEAST, TIMES * q) and not _smaller_period(words, lo, q):
            found.add((lo, hi, q))

    longest = int(sizes[0]) if len(docs) else 0
    part = words[: int(ends[np.count_nonzero(sizes >= LEAST) - 1])] if longest >= LEAST else words[:0]
    for q in range(1, SHORT + 1):
        for lo, hi in lag_runs(part, q, LEAST):
            add(lo, hi, q)
    strings = Strings(part, longest) if longest >= TIMES * (SHORT + 1) else None
    for least, k, width in scales(longest):
        end = int(ends[np.count_nonzero(sizes >= TIMES * least) - 1])
        h = strings.of(k, end)
        if len(h) < width:
            continue
        low = sliding(h, width, np.minimum)
        edge = np.zeros(width - 1, U)
        best = sliding(np.concatenate([edge, low, edge]), width, np.maximum)  # largest minimum of the windows around
        at = np.flatnonzero(best == h)
        at = at[np.argsort(h[at], kind="stable")]
        lag = np.diff(at)
        seed = (h[at[1:]] == h[at[:-1]]) & (lag >= least) & (lag <= k)
        at, lag = at[:-1][seed], lag[seed]
        for lo, hi, q in sorted(set(zip(*(x.tolist() for x in (*strings.extend(at, lag), lag))))):
            if hi - lo < TIMES * q:
                continue
            if np.array_equal(words[lo : hi - q], words[lo + q : hi]):
                add(lo, hi, q)
            else:  # two strings of one hash: the lag is scanned instead
                d = int(np.searchsorted(ends, lo, "right"))
                base = int(starts[d])
                for a, b in lag_runs(words[base : int(ends[d])], q, TIMES * q):
                    add(base + a, base + b, q)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for lo, hi, q in sorted((lo, hi, q) for lo, hi, q in found):
        d = int(np.searchsorted(ends, lo, "right"))
        out[order[d]].append((lo - int(starts[d]), hi - lo, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def _numbered(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: one row per row of ``docs``.

    Words stand between ASCII white space and are compared byte by byte. A run is listed under its smallest
    period and reaches as far as that period does; it has ``LEAST`` words and ``TIMES`` periods at least.
    ``collapsed`` is the text without the words that a run holds after its first period, joined by one space.
    Null and empty texts have no words and no runs; rows that repeat an id or a text are each answered, ids
    may be null or of any type, other columns are not looked at, and no rows give no rows. A text of any length is
    worked on whole, in memory in proportion to it.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    flat = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answer(ids: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        runs = runs_in([_numbered(w, numbers) for w in lists])
        texts = [
            b" ".join([w[i] for i in np.flatnonzero(kept_words(len(w), r)).tolist()] if r else w)
            for w, r in zip(lists, runs)]
        ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        columns = list(zip(*(x for r in runs for x in r))) or [(), (), ()]
        items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], fields=list(flat))
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([len(w) for w in lists], pa.int64()),
             pa.ListArray.from_arrays(pa.array(ends), items), pa.array(texts, pa.binary())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists, size, lo = b[0], [], 0, 0
            for i, t in enumerate(b[1]):
                words = t.as_py().split()
                if lists and size + len(words) > BATCH_WORDS:
                    yield answer([ids[lo:i]], lists)
                    lists, size, lo = [], 0, i
                lists.append(words)
                size += len(words)
            if lists:
                yield answer([ids[lo:]], lists)

    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    found = arrow_map(rows, run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", c("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """Of ``runs`` the one with the greatest length / period; ties: smallest start, then period. None: null."""
    def better(best, x):
        left, right = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (left > right), x).otherwise(best)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, better)


def run_lines(runs: Column) -> Column:
    """Every run's ``start,length,period`` and a line feed."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.concat(F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), ""), F.lit(""))


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every tenth text made periodic from some word on, by the checksum of its id.

    With h = crc32 of the decimal id and g = h div 10, a text with h mod 10 = 0 keeps its first a = g mod n words, and the
    others repeat the next p = 1 + (n - a) div (3 + g mod 8) words. Texts without words and rows without an id stay.
    """
    prepare(docs.sparkSession)
    h = F.crc32(c(doc_id).cast("string"))
    planted = docs.withColumns({"__g": F.floor(h / 10), "__words": F.array_remove(F.split(F.when(h % 10 == 0, c(text)), r"[\x20\x09-\x0D]+"), "")})
    n = F.size("__words")
    planted = planted.withColumn("__a", F.when(n > 0, c("__g") % n))
    p = (1 + F.floor((n - c("__a")) / (3 + c("__g") % 8))).cast("int")
    planted = planted.withColumns({"__p": F.when(n > 0, p), "__a": c("__a").cast("int")})
    head = F.slice("__words", 1, c("__a"))
    unit = F.slice("__words", c("__a") + 1, c("__p"))
    times = F.ceil((n - c("__a")) / c("__p")).cast("int")
    body = F.slice(F.flatten(F.array_repeat(unit, times)), 1, n - c("__a"))
    made = F.array_join(F.concat(head, body), " ")
    return planted.withColumn(text, F.when(c("__p").isNotNull(), made).otherwise(c(text))).drop("__g", "__words", "__a", "__p")

"""Removal of repeated byte strings by sorting sampled suffixes.

A 400-byte string is removed wherever it starts more than once. Suffixes are sampled by content: of
every 400-byte window the 128-byte gram of least hash is an anchor, so both copies of a repeated string
hold the same anchor at the same place, and about one suffix in 130 is kept. Anchors whose whole
surroundings recur are settled by hash. The others are sorted twice, by what follows and by what
precedes: sampled splitters range-partition them by leading bytes, buckets are sorted locally by
multikey quicksort on eight-byte words, and neighbours are compared, across bucket boundaries too. That
gives the longest match to the right and to the left. Where neighbours attain both, the removed
span is exact; what remains (different partners to the left and right) is settled by hashing the windows
around the anchor, first what blocks of them share, then those of blocks that recur. No step pairs up the members of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, utf8, written
from timbrel.llm.decontaminate import bounded
from timbrel.session import steps

c = F.col
LENGTH, GRAM = 400, 128
PIECE = 1 << 20  # windows of a text that are looked at together
BUCKET_BYTES = 24 << 20
STEP = 50  # bytes between the offsets of the shorter strings that are looked up before sorting
BLOCK = 16  # windows that are looked up together, by what they share, before each alone

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") for b in range(256)], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every run of ``width`` elements, in three passes."""
    n = len(a) - width + 1
    padded = np.r_[a, np.full(-len(a) % width, a[-1], a.dtype)].reshape(-1, width)
    ahead = op.accumulate(padded, axis=1).reshape(-1)
    behind = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window of ``length`` bytes, ties included."""
    out, width = {}, length - gram + 1
    for lo in range(0, len(data) - length + 1, PIECE):
        raw = np.frombuffer(data[lo : lo + PIECE + length - 1], np.uint8)
        n = len(raw) - gram + 1
        sums = np.r_[np.uint64(0), np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)))]
        h = (sums[gram:] - sums[:-gram]) * _powers(_BACK, n)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = _slide(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_slide(np.r_[edge, least, edge], width, np.maximum) == h)
        out.update(zip((at + lo).tolist(), h[at].view(np.int64).tolist()))
    return np.fromiter(out.keys(), np.int64, len(out)), np.fromiter(out.values(), np.int64, len(out))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, places, grams, rooms, kinds = [], [], [], [], []
            for i, data in enumerate(b[1].to_pylist()):
                at, h = anchors(data)
                for a in at.tolist():
                    left = data[max(0, a - LENGTH + GRAM) : a]
                    kinds.append(xxhash.xxh3_64_intdigest(len(left).to_bytes(2, "big") + left + data[a : a + LENGTH]))
                owner.append(np.full(len(at), i))
                places.append(at)
                grams.append(h)
                rooms.append(np.minimum(LENGTH, len(data) - at))
            if kinds:
                yield pa.RecordBatch.from_arrays([
                    b[0].take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(places), pa.int64()),
                    pa.array(np.concatenate(grams), pa.int64()), pa.array(np.concatenate(rooms).astype(np.int32)),
                    pa.array(np.array(kinds, np.uint64).view(np.int64)),
                ], names=["text_key", "pos", "gram", "room", "around"])

    return arrow_map(texts, run, "text_key binary, pos long, gram long, room int, around long")


def _contexts(texts: DataFrame) -> DataFrame:
    """(text_key, pos, after, before, shorter): what follows an anchor, what precedes its gram's end, reversed,
    and hashes of strings around it, one of which any repeated string of the length must hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, after, before = [], [], [], []
            for key, data, some in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist()):
                for a in some:
                    keys.append(key)
                    places.append(a)
                    after.append(data[a : a + LENGTH])
                    before.append(data[max(0, a - LENGTH + GRAM) : a + GRAM][::-1])
                if len(keys) >= 20_000:
                    yield _context_batch(keys, places, after, before)
                    keys, places, after, before = [], [], [], []
            yield _context_batch(keys, places, after, before)

    return arrow_map(texts, run, "text_key binary, pos long, after binary, before binary, shorter array<long>")


def _shorter(after: bytes, before: bytes) -> list[int]:
    """A match that begins j bytes before the anchor, o <= j < o + STEP, holds the LENGTH - STEP bytes from o before it on."""
    left = before[GRAM:][::-1]
    whole, out = left + after, []
    for o in range(0, LENGTH - GRAM + 1, STEP):
        lo = len(left) - o
        if lo >= 0 and lo + LENGTH - STEP <= len(whole):
            h = xxhash.xxh3_64_intdigest(whole[lo : lo + LENGTH - STEP], o)
            out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _context_batch(keys, places, after, before) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(after, pa.binary()), pa.array(before, pa.binary()),
         pa.array(list(map(_shorter, after, before)), pa.list_(pa.int64()))],
        names=["text_key", "pos", "after", "before", "shorter"])


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    raw = np.frombuffer(b"".join(s.ljust(LENGTH, b"\0") for s in strings), np.uint8)
    return raw.reshape(len(strings), LENGTH), sizes


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of words: sort by the first word, then only what is tied by the next one, and so on."""
    n = len(words)
    order, group, tied = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for d in range(words.shape[1]):
        key = words[order[tied], d]
        by = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][by], key[by]
        g = group[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        same = ~new
        tied = tied[same | np.r_[same[1:], False]]
        if not len(tied):
            break
    return order


def _common(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of padded rows."""
    differ = x != y
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return np.minimum(first, np.minimum(nx, ny))


def _found(keys, places, best, right, left) -> pa.RecordBatch:
    """Extensions of a match count only if together they reach the length."""
    good = left + right >= LENGTH
    return pa.RecordBatch.from_pydict({
        "text_key": pa.array(keys, pa.binary()), "pos": pa.array(places, pa.int64()), "best": pa.array(best, pa.int64()),
        "left": pa.array(np.where(good, left, -1), pa.int64()), "right": pa.array(np.where(good, right, -1), pa.int64()),
        "bucket": pa.nulls(len(places), pa.int32()), "after": pa.nulls(len(places), pa.binary()),
        "before": pa.nulls(len(places), pa.binary()), "last": pa.nulls(len(places), pa.bool_()),
    })


SORTED = ("text_key binary, pos long, best long, left long, right long, bucket int, after binary, before binary, last boolean")


def _pairs(xa, xb, ya, yb, forward: bool):
    """(best, right, left) of pairs of contexts given as (matrix, sizes)."""
    right = _common(xa[0], ya[0], xa[1], ya[1])
    left = _common(xb[0], yb[0], xb[1], yb[1])
    best = right if forward else left - GRAM
    match = (right >= GRAM) & (left >= GRAM)
    return np.where(match, best, -1), np.where(match, right, -1), np.where(match, left - GRAM, -LENGTH)


def _neighbours(contexts: DataFrame, n: int, forward: bool) -> DataFrame:
    """Per anchor and neighbour in sorted order: best, and valid left and right extensions."""
    first, second = ("after", "before") if forward else ("before", "after")
    placed = contexts.repartitionByRange(n, first, second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*(b[k].to_pylist() for k in ("text_key", "pos", "after", "before")))]
        if not rows:
            return
        keys, places, after, before = map(list, zip(*rows))
        a, b = _matrix(after), _matrix(before)
        x, y = (a, b) if forward else (b, a)
        as_words = lambda m: np.hstack([m[0].view(">u8"), m[1][:, None].astype(np.uint64)])
        order = multikey_order(np.hstack([as_words(x), as_words(y)]))
        keys, places = [keys[i] for i in order], np.array(places)[order]
        a, b = (a[0][order], a[1][order]), (b[0][order], b[1][order])
        head, tail = lambda m: (m[0][:-1], m[1][:-1]), lambda m: (m[0][1:], m[1][1:])
        best, right, left = _pairs(head(a), head(b), tail(a), tail(b), forward)
        yield _found(keys[:-1], places[:-1], best, right, left)
        yield _found(keys[1:], places[1:], best, right, left)
        bucket = TaskContext.get().partitionId()
        ends = [0, len(keys) - 1]
        none = [None, None]
        yield pa.RecordBatch.from_pydict({
            "text_key": pa.array([keys[i] for i in ends], pa.binary()), "pos": pa.array([int(places[i]) for i in ends], pa.int64()),
            "best": pa.array(none, pa.int64()), "left": pa.array(none, pa.int64()), "right": pa.array(none, pa.int64()),
            "bucket": pa.array([bucket] * 2, pa.int32()),
            "after": pa.array([after[order[i]] for i in ends], pa.binary()), "before": pa.array([before[order[i]] for i in ends], pa.binary()),
            "last": pa.array([False, True], pa.bool_()),
        })

    found = written(arrow_map(placed.select("text_key", "pos", "after", "before"), run, SORTED), "neighbours")
    ends = found.where("bucket is not null")
    # the next bucket with rows; one number per bucket
    following = ends.select("bucket").distinct().withColumn("next", F.lead("bucket").over(Window.orderBy("bucket")))
    fields = ("text_key", "pos", "after", "before")
    lasts = ends.where("last").join(following, "bucket").select("next", *(c(x).alias(f"{x}_1") for x in fields))
    firsts = ends.where("not last").select(c("bucket").alias("next"), *(c(x).alias(f"{x}_2") for x in fields))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if len(t):
                col = lambda k: t[k].to_pylist()
                m = {k: _matrix(col(k)) for k in ("after_1", "before_1", "after_2", "before_2")}
                got = _pairs(m["after_1"], m["before_1"], m["after_2"], m["before_2"], forward)
                yield _found(col("text_key_1"), col("pos_1"), *got)
                yield _found(col("text_key_2"), col("pos_2"), *got)

    crossing = arrow_map(lasts.join(firsts, "next"), across, SORTED)
    return found.where("bucket is null").unionByName(crossing).select("text_key", "pos", "best", "left", "right")


def _windows(contexts: DataFrame, step: int = 1) -> DataFrame:
    """(row, open, back, h0, h1, wide, most, least): hashes of those windows of the length around each anchor that may decide an open one.

    A window that begins ``back`` bytes before an anchor recurs only if some match reaches as far to the left and to
    the right, so ``back`` lies between LENGTH - most_right and most_left; of these the ones in the two ranges
    that are still asked for are looked at, and of these the ones in the blocks of BLOCK that ``among`` names, if it
    is there. With a ``step`` one row stands for the windows of as many ``back``: its hash is of the bytes that all of them
    hold, and ``wide`` of the bytes that any of them holds; ``most`` and ``least`` are the ones that are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, opens, places, hashes, wide, most, least = [], [], [], [], [], [], []
            for row, open_, after, before, among, lo, hi, *asked in zip(*(x.to_pylist() for x in b.columns)):
                left = before[GRAM:][::-1]
                whole = left + after
                backs = set()
                for x, y in (asked[:2], asked[2:]):
                    if x is not None:
                        backs.update(range(max(x, lo), min(y, hi) + 1))
                if among is not None:
                    backs = {j for j in backs if j - j % BLOCK in among}
                some = sorted({j - j % step for j in backs})
                for j in some:
                    at = len(left) - j
                    hashes.append(xxhash.xxh3_128_digest(j.to_bytes(2, "big") + whole[at : at + LENGTH - step + 1]))
                    own = [i for i in range(j, j + step) if i in backs]
                    most.append(own[-1])
                    least.append(own[0])
                    far = max(0, at - step + 1)
                    wide.append(xxhash.xxh3_128_digest((at - far).to_bytes(2, "big") + whole[far : at + LENGTH]))
                rows += [row] * len(some)
                opens += [open_] * len(some)
                places += some
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(opens, pa.bool_()), pa.array(places, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1]),
                 pa.array(wide, pa.binary()), pa.array(most, pa.int32()), pa.array(least, pa.int32())],
                names=["row", "open", "back", "h0", "h1", "wide", "most", "least"])

    if "among" not in contexts.columns:
        contexts = contexts.withColumn("among", F.lit(None).cast("array<int>"))
    return arrow_map(
        contexts.select("row", "open", "after", "before", "among", "lo", "hi", "far_from", "far_to", "near_from", "near_to"), run,
        "row long, open boolean, back int, h0 long, h1 long, wide binary, most int, least int")


def _recurring(windows: DataFrame, name: str) -> DataFrame:
    """The rows of the hashes that occur more than once, at an open anchor too."""
    windows = written(windows, name)
    again = windows.groupBy("h0", "h1").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("h0", "h1")
    return windows.join(bounded(written(again, "again")), ["h0", "h1"], "left_semi")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(text_key, start, end): spans of repeated bytes from rows (text_key, text), overlapping ones included."""
    with steps(texts.sparkSession) as keep:
        found = written(_anchor_rows(texts), "anchors")
        often = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
        often = bounded(written(often, "shared-grams"))
        rows = keep(found.join(often, "gram", "left_semi"), "shared-anchors")
    kinds = written(rows.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("text_key", "pos")).alias("at")), "surroundings")
    whole = rows.join(bounded(kinds.where("n > 1").select("gram", "around")), ["gram", "around"], "left_semi").select(
        "text_key", (c("pos") - F.least(c("pos"), F.lit(LENGTH - GRAM))).alias("start"), (c("pos") + c("room")).alias("end"))
    rivals = kinds.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    items = written(kinds.join(rivals, "gram", "left_semi").select("gram", "n", "at.text_key", "at.pos"), "items")
    n_items = items.count()
    if not n_items:
        return whole.distinct()
    wanted = items.groupBy("text_key").agg(F.collect_list("pos").alias("places"))  # at most the anchors of one text
    # copies of a text combine before the shuffle
    some = texts.join(bounded(items.select("text_key").distinct()), "text_key", "left_semi")
    distinct = some.groupBy("text_key").agg(F.first("text").alias("text"))
    with steps(texts.sparkSession) as keep:
        every = _contexts(distinct.join(wanted, "text_key").select("text_key", "text", "places"))
        every = written(every.withColumn("row", F.monotonically_increasing_id()), "contexts")
        hashes = every.select("row", F.explode("shorter").alias("h"))
        again = hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        open_ = hashes.join(bounded(written(again, "shorter")), "h", "left_semi").select("row").distinct()
        contexts = keep(every.drop("shorter").join(bounded(written(open_, "open")), "row", "left_semi").drop("row"), "contexts")
    buckets = max(1, contexts.count() * 2 * LENGTH // BUCKET_BYTES)
    to_right, to_left = _neighbours(contexts, buckets, True), _neighbours(contexts, buckets, False)
    both = to_right.select("*", c("best").alias("most_right"), F.lit(-1).cast("long").alias("most_left")).unionByName(
        to_left.select("*", F.lit(-1).cast("long").alias("most_right"), c("best").alias("most_left")))
    state = both.groupBy("text_key", "pos").agg(*(F.max(x).alias(x) for x in ("most_right", "most_left", "left", "right")))
    state = state.where(c("most_right") + c("most_left") >= LENGTH)
    state = written(state.withColumn("settled", (c("left") == c("most_left")) & (c("right") == c("most_right"))), "matches")
    settled = state.where("settled").select(
        "text_key", (c("pos") - c("left")).alias("start"), (c("pos") + c("right")).alias("end"))
    out = whole.union(settled)
    open_ = state.where("not settled")
    if not open_.isEmpty():
        # what lies beyond the matches already known, by gram: farther to the left, and farther to the right
        left, right = c("left") < c("most_left"), c("right") < c("most_right")
        wanted = items.join(open_, ["text_key", "pos"]).groupBy("gram").agg(
            F.min(F.when(left, c("left") + 1)).alias("far_from"), F.max(F.when(left, c("most_left"))).alias("far_to"),
            F.min(F.when(right, LENGTH - c("most_right"))).alias("near_from"), F.max(F.when(right, LENGTH - c("right") - 1)).alias("near_to"))
        near = items.select("gram", "text_key", "pos").join(wanted, "gram").join(state, ["text_key", "pos"]).drop("gram").withColumns({
            "lo": LENGTH - c("most_right"), "hi": c("most_left"), "open": ~c("settled"), "row": F.monotonically_increasing_id()})
        near = written(near, "near")
        # a block of windows at once: most have nothing in common that recurs. Where all of a block's bytes recur, so
        # does each of its windows, and one row looks its windows up for all rows that have these bytes
        blocks = written(_recurring(_windows(contexts.join(near, ["text_key", "pos"]), BLOCK), "blocks"), "shared-blocks")
        same = written(blocks.groupBy("h0", "h1", "back", "wide").agg(
            F.count("*").alias("n"), F.min("row").alias("row"), F.max("open").alias("open")), "same")
        whole_blocks = blocks.where("open").join(same.where("n > 1").select("h0", "h1", "wide"), ["h0", "h1", "wide"], "left_semi")
        mixed = same.groupBy("h0", "h1").agg(F.count("*").alias("k"), F.max((c("n") == 1) & c("open")).alias("asks")).where("k > 1 and asks")
        among = same.join(mixed, ["h0", "h1"], "left_semi").groupBy("row").agg(F.collect_list("back").alias("among"))  # at most LENGTH / BLOCK
        windows = _recurring(_windows(contexts.join(near.join(written(among, "among"), "row"), ["text_key", "pos"])), "windows")
        last = whole_blocks.select("row", "most", "least").union(windows.where("open").select("row", "most", "least")).groupBy("row").agg(
            F.max("most").alias("most"), F.min("least").alias("least"))
        # a neighbour's match, where it reaches the length, is known as well
        most = F.greatest("most", F.when(c("left") >= 0, c("left")))
        least = F.least("least", F.when(c("right") >= 0, LENGTH - c("right")))
        last = near.where("open").join(last, "row", "left").select("text_key", "pos", most.alias("most"), least.alias("least")).where(
            "most is not null and least is not null")
        out = out.union(last.select("text_key", (c("pos") - c("most")).alias("start"), (c("pos") - c("least") + LENGTH).alias("end")))
    return out.distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left), one row per row of ``docs``.

    Every byte covered by a 400-byte string that also starts elsewhere, in another row or the same, is
    removed, from all its places; texts are UTF-8 bytes, null counts as empty, matches never cross rows.
    Rows that repeat an id or a text are rows like any other. No rows give none.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text")).withColumn("text_key", F.unhex(F.md5("text")))
    with steps(docs.sparkSession) as keep:
        spans = repeated_spans(rows.where(F.octet_length("text") >= LENGTH).select("text_key", "text"))
        lists = keep(spans.groupBy("text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")  # of one text
    touched = bounded(lists.select("text_key"))  # texts without spans need no shuffle
    joined = rows.join(touched, "text_key", "left_semi").join(lists, "text_key").select("doc_id", "text", "spans").unionByName(
        rows.join(touched, "text_key", "left_anti").select("doc_id", "text", F.lit(None).cast(lists.schema["spans"].dataType).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, n, hashes, kept = [], [], [], [], []
            for data, some in zip(b[1].to_pylist(), b[2].to_pylist()):
                cut = merged([(x["start"], x["end"]) for x in some or ()])
                edges = [0, *(x for s in cut for x in s), len(data)]
                rest = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                sizes.append(len(data))
                removed.append(len(data) - len(rest))
                n.append(len(cut))
                hashes.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [b[0], *(pa.array(x, pa.int64()) for x in (sizes, removed, n)), pa.array(hashes, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return arrow_map(joined, run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits share a variant that differs from either in at most
one. So every distinct fingerprint emits itself and its one-bit variants, and fingerprints meet by
a shuffle on variants. A variant has at most ``bits`` + 1 distinct neighbours, whatever the number of
documents, and these fit one bit mask: the meeting is an aggregation of primitive values with
map-side combine, hot groups included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, settled, utf8
from timbrel.llm.components import components
from timbrel.llm.decontaminate import bounded
from timbrel.session import materialise, steps

c = F.col
RADIUS = 2  # bits; half of it is emitted by each side
PIECE = 1 << 15  # shingles whose bits are counted at once


def shingles(data: bytes, words: int) -> list[bytes]:
    """Shingles of A-Z-lower-cased words between ASCII spaces; fewer words give the whole sequence, none nothing."""
    w = data.lower().split()
    if len(w) < words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(words)))))


def majority(items: list[bytes], digest) -> bytes:
    """The bits set in over half the digests; zero bytes without items."""
    width = len(digest(b""))
    total = np.zeros(width * 8, np.int64)
    for lo in range(0, len(items), PIECE):
        some = items[lo : lo + PIECE]
        raw = np.frombuffer(b"".join(map(digest, some)), np.uint8).reshape(len(some), width)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(items)).tobytes()


def _xxh64(item: bytes) -> bytes:
    return xxhash.xxh64_digest(item, 42)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each row's whole text as a signed long. Null counts as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [int.from_bytes(majority(shingles(t, words), _xxh64), "big", signed=True) for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(got, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    return arrow_map(rows, prints, f"doc_id {kind}, fp long")


def _bit(i):
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def ball_buckets(values: DataFrame, bits: int) -> DataFrame:
    """(block, variant, u): the values within one bit of a variant, for variants with two or more.

    ``values`` has distinct (block, value long), block 0 alone if values have 64 bits. Any two values
    within two bits share a bucket, and a bucket has ``bits`` + 1 values at most.
    """
    one = bits < 64  # then the value itself is one more bit of the mask, and the block part of the key
    key = c("block").cast("long") * (1 << bits) + c("value") if one else c("value")
    variants = values.select(key.alias("key"), F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("i"))
    flip = F.when(c("i") < bits, _bit(c("i"))).otherwise(F.lit(0).cast("long"))
    if one:
        met = variants.select(c("key").bitwiseXOR(flip).alias("key"), _bit(c("i")).alias("mask")).groupBy("key").agg(
            F.bit_or("mask").alias("mask"))
        met = met.where(F.bit_count("mask") > 1)
        own = c("mask").bitwiseAND(F.lit(1 << bits)) != 0
    else:
        met = variants.select(c("key").bitwiseXOR(flip).alias("key"), flip.alias("mask"), (c("i") == bits).alias("own")).groupBy("key").agg(
            F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
        own = c("own")
        met = met.where(F.bit_count("mask") + own.cast("int") > 1)
    flips = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: c("mask").bitwiseAND(_bit(i)) != 0)
    others = F.transform(flips, lambda i: c("key").bitwiseXOR(_bit(i)))
    members = F.when(own, F.array_append(others, c("key"))).otherwise(others)
    out = met.select("key", F.explode(members).alias("u"))
    if not one:
        return out.select(F.lit(0).alias("block"), c("key").alias("variant"), "u")
    low = F.lit((1 << bits) - 1)
    return out.select(
        F.shiftright("key", bits).cast("int").alias("block"), c("key").bitwiseAND(low).alias("variant"), c("u").bitwiseAND(low).alias("u"))


def ball_links(values: DataFrame, bits: int) -> DataFrame:
    """(block, u, v): links that connect all values of a block within ``RADIUS`` bits of each other.

    Each bucket links its members to the least of them: both differ from the variant in at most one
    bit, so the link itself is within the radius.
    """
    buckets = materialise(ball_buckets(values, bits), "buckets")
    hubs = buckets.groupBy("block", "variant").agg(F.min("u").alias("v"))
    linked = buckets.join(hubs, ["block", "variant"]).select("block", "u", "v")
    return linked.where((c("u") != c("v")) & (F.bit_count(c("u").bitwiseXOR(c("v"))) <= RADIUS)).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``.

    Fingerprints within two bits are linked; component_id is the smallest doc_id reachable, itself
    included. A text without words has fingerprint zero and is linked like any other. Rows that
    repeat a doc_id each get a row; a null doc_id joins its component but names none (a component of
    nulls alone has a null id). An empty table gives no rows; other columns are not looked at.
    """
    prints = materialise(fingerprints(docs, doc_id, text, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    values = nodes.select(F.lit(0).alias("block"), c("fp").alias("value"))
    found = components(ball_links(values, 64), "u", "v")
    comp = nodes.join(found, c("fp") == c("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    comp = materialise(comp, "classes")
    least = comp.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = comp.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Signatures of shingle sets: the least of ROWS * BANDS orders of the set. Each band is a key of ROWS minima, so two
# sets share a band with the probability similarity ** ROWS, and some band, at 0.8, with 1 - 5e-6, however they differ.
ROWS, BANDS = 6, 40
SMALL = 16  # documents of a key that are paired at once
STARS = 3  # hubs of a larger key before the unlinked rest is paired
CHUNK = 256  # shingles put in all orders at once
SKETCH = ("s0", "s1", "s2", "s3")
# One bit of each of the 240 minima is kept: of these 24 differ on average at similarity 0.8 (deviation 4.6).
FAR = 64
# The parity of the number of shingles in each of 512 hashed bins. Where two texts' parities differ, a shingle is in one
# set alone, so their difference is at least that large: a bound that loses nothing.
PARITY = tuple(f"p{i}" for i in range(8))
_ORDERS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64)
_ORDERS[1] |= np.uint64(1)


def minima(grams: np.ndarray) -> np.ndarray:
    """The least value of the distinct shingles' hashes in each of the orders."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), CHUNK):
        some = grams[lo : lo + CHUNK].view(np.uint64)[:, None] ^ _ORDERS[0]
        some *= _ORDERS[1]
        np.minimum(least, some.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """One hash for each band, which differs between bands."""
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(rows)]


def parities(grams: np.ndarray) -> bytes:
    """One bit for each bin of the distinct shingles' hashes: whether it holds an odd number of them."""
    width = 64 * len(PARITY)
    bins = (grams.view(np.uint64) >> np.uint64(65 - width.bit_length())).view(np.int64)
    return np.packbits((np.bincount(bins, minlength=width) & 1).astype(np.uint8)).tobytes()


def _grams(texts: list[bytes], words: int) -> np.ndarray:
    """Hashes of the distinct shingles of all texts together, in order."""
    return np.unique(np.frombuffer(b"".join(_xxh64(g) for t in texts for g in set(shingles(t, words))), "<i8"))


def _by_document(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, texts): the texts of the rows of each id; only ids that occur in several rows are shuffled."""
    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text")).where("doc_id is not null")
    often = bounded(materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "often"))
    return rows.join(often, "doc_id", "left_anti").select("doc_id", F.array("text").alias("texts")).union(
        rows.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("text").alias("texts")))


def _set_prints(texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, h0, h1, size, s0 .. s3, p0 .. p7, keys): hash and size of the shingle set, its sketch, its parities and its bands; no bands if it is empty."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h0", "h1", "size", *SKETCH, *PARITY, "keys"]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, sizes, sketches, odd, keys = [], [], [], [], []
            for t in b[1].to_pylist():
                grams = _grams(t, words)
                least = minima(grams)
                whole.append(xxhash.xxh3_128_digest(grams.tobytes()))
                sizes.append(len(grams))
                sketches.append(np.packbits((least >> np.uint64(7) & np.uint64(1)).astype(np.uint8)).tobytes().ljust(32, b"\0"))
                odd.append(parities(grams))
                keys.append(band_keys(least) if len(grams) else [])
            h = np.frombuffer(b"".join(whole), "<i8").reshape(-1, 2)
            s = np.frombuffer(b"".join(sketches), "<i8").reshape(-1, 4)
            p = np.frombuffer(b"".join(odd), "<i8").reshape(-1, len(PARITY))
            yield pa.RecordBatch.from_arrays(
                [b[0], *(pa.array(h[:, i]) for i in range(2)), pa.array(sizes, pa.int32()), *(pa.array(s[:, i]) for i in range(4)),
                 *(pa.array(p[:, i]) for i in range(len(PARITY))), pa.array(keys, pa.list_(pa.int64()))], names=names)

    return arrow_map(texts, prints, f"doc_id {kind}, h0 long, h1 long, size int, " + ", ".join(f"{x} long" for x in (*SKETCH, *PARITY)) + ", keys array<long>")


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_grams(t, words) for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "grams"])

    return arrow_map(texts, sets, f"doc_id {kind}, grams array<long>")


def similar_pairs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """(a, b): links that connect all documents whose sets of five-word shingles have Jaccard 0.8 or more.

    Equal sets are linked to their least document, which alone goes on. Documents whose fingerprints lie in one
    component of ``near_duplicates`` are verified against its least document first. All other candidates share one of 40 bands of 6
    minima over the shingles themselves, so whether a pair is found depends on its similarity alone: with
    1 - 5e-6 at 0.8, whether words are replaced, a part is cut off or one is appended. Every pair of documents
    that share a band is verified on the exact sets, unless other links connect it already. An id that occurs in
    several rows stands for one document with the shingles of its rows together.

    Of a key with more than 16 documents the one that shares most is verified against all that no link connects
    to it, and leaves; in a group of altered copies it is their original, which links most of them. After
    three such turns what is still unlinked in a key is verified against all others of it whose sketches and
    parities allow the similarity.
    """
    texts = _by_document(docs, doc_id, text)
    prints = materialise(_set_prints(texts, words), "prints")
    same = prints.groupBy("h0", "h1").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    equal = prints.join(bounded(materialise(same, "same")), ["h0", "h1"]).select("a", c("doc_id").alias("b")).where("a <> b")
    equal = materialise(equal, "equal")
    one = prints.join(bounded(equal.select(c("b").alias("doc_id"))), "doc_id", "left_anti")
    bands = one.select("doc_id", F.explode("keys").alias("key"))
    met = bounded(materialise(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met"))
    shared = materialise(bands.join(met, "key"), "shared")
    named = bounded(materialise(shared.select("doc_id").distinct(), "named"))
    sketches = materialise(prints.select("doc_id", "size", *SKETCH, *PARITY).join(named, "doc_id", "left_semi"), "sketches")
    sets = materialise(_shingle_sets(texts.join(named, "doc_id", "left_semi"), words), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        return settled(_verified(_close(pairs.distinct(), sketches, similarity), sets, similarity), "links")

    near = near_duplicates(docs, doc_id, text).where("component_id <> doc_id").select(
        c("component_id").alias("a"), c("doc_id").alias("b"))
    links = equal.union(check(near)).union(check(_all_pairs(shared.where(c("n") <= SMALL))))
    weights = materialise(shared.groupBy("doc_id").agg(F.sum("n").alias("weight")), "weights")
    groups = materialise(shared.where(c("n") > SMALL).join(weights, "doc_id").select("key", "doc_id", "weight"), "groups")
    for turn in range(STARS + 1):
        if groups.isEmpty():
            break
        # components stand for the links that they were made from
        found = components(links, "a", "b")
        links = found.where("node <> component").select(c("component").alias("a"), c("node").alias("b"))
        parts = _unlinked(groups, found)
        if turn == STARS:
            sketched = materialise(parts.join(sketches, "doc_id"), "sketched")
            found = settled(_verified(_across(sketched, similarity).distinct(), sets, similarity), "links")
            links = links.union(found)
            break
        hubs = parts.groupBy("key").agg(F.max(F.struct("weight", F.xxhash64("doc_id").alias("h"), "doc_id", "part")).alias("hub"))
        starred = settled(parts.join(hubs, "key"), "starred")
        pairs = starred.where(c("part") != c("hub.part")).select(c("doc_id").alias("a"), c("hub.doc_id").alias("b"))
        links = links.union(check(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
        groups = starred.where(c("doc_id") != c("hub.doc_id")).select("key", "doc_id", "weight")
    return links

def _all_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): every two documents of a key."""
    side = lambda k: shared.select("key", c("doc_id").alias(k))
    return side("a").join(side("b"), "key").where("a < b").select("a", "b")


def _unlinked(groups: DataFrame, found: DataFrame) -> DataFrame:
    """``groups`` with the ``part`` of ``found`` components that each document is in; only keys that hold several parts."""
    parts = materialise(groups.join(found, c("doc_id") == c("node"), "left").select(
        *groups.columns, F.coalesce("component", "doc_id").alias("part")), "parts")
    mixed = parts.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    return materialise(parts.join(mixed, "key", "left_semi"), "mixed")


def _across(sketched: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the close documents of different parts of a key; its largest part is not paired with itself.

    The join itself holds sketches against each other, so pairs that are not close are never rows.
    """
    sizes = sketched.groupBy("key", "part").agg(F.count("*").alias("n"))
    top = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("top"))
    side = lambda rows, k: rows.select("key", *(c(x).alias(f"{k}_{x}") for x in ("doc_id", "part", "size", *SKETCH, *PARITY)))
    rest = side(sketched.join(top, "key").where(c("part") != c("top.part")), "a").withColumnRenamed("key", "own")
    met = rest.join(side(sketched, "b"), (c("own") == c("key")) & (c("a_part") != c("b_part")) & _may_be(similarity))
    return met.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b"))


def _may_be(similarity: float):
    """Whether sizes, sketches and parities of the sides ``a_`` and ``b_`` allow the similarity.

    Of 240 sketched bits more than 64 differ with a probability below 1e-13 at similarity 0.8. Sets of similarity s
    differ in at most (1 - s) / (1 + s) of their sizes' sum, and in no fewer shingles than their parities do.
    """
    apart = lambda names: sum((F.bit_count(c(f"a_{x}").bitwiseXOR(c(f"b_{x}"))) for x in names), F.lit(0))
    sized = F.least("a_size", "b_size") >= similarity * F.greatest("a_size", "b_size")
    most = (1 - similarity) / (1 + similarity) * (c("a_size") + c("b_size")) + 1e-6
    return (apart(SKETCH) <= FAR) & sized & (apart(PARITY) <= most)


def _close(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes, sketches and parities allow the similarity."""
    side = lambda k: sketches.select(c("doc_id").alias(k), *(c(x).alias(f"{k}_{x}") for x in ("size", *SKETCH, *PARITY)))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_be(similarity)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    joined = (
        pairs.join(sets.select(c("doc_id").alias("a"), c("grams").alias("x")), "a")
        .join(sets.select(c("doc_id").alias("b"), c("grams").alias("y")), "b")
    )
    both = F.size(F.array_intersect("x", "y"))
    return joined.select("a", "b", both.alias("n"), (F.size("x") + F.size("y") - both).alias("all")).where(
        (c("n") >= similarity * c("all")) | (c("all") == 0)).select("a", "b")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which the smallest doc_id of each linked group stays, all columns kept.

    Texts without words are alike. Rows with a null doc_id are not compared and stay, and so do all
    rows that share the doc_id that stays.
    """
    with steps(docs.sparkSession) as keep:
        found = components(similar_pairs(docs, doc_id, text, **options), "a", "b")
        lost = keep(found.where("node <> component").select(c("node").alias("__lost")), "lost")
    lost = bounded(lost)
    return docs.join(lost, c(doc_id) == c("__lost"), "left_anti")

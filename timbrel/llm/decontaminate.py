"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

A window as long as a benchmark item is fingerprinted where it holds at least one shingle of that
item (without one the similarity is zero, so nothing is lost). Multi-index blocks find every window
within ``RADIUS`` bits of its item: the radius spread over seven blocks leaves at most two differing
bits in one of them, so items emit all block values within two bits and windows only their own.
Candidates are verified by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import lower_az, prepare
from timbrel.session import materialise, steps

c = F.col
WORDS, SIMILARITY = 5, 0.8
# At similarity 0.8 a window shares 8 of 9 shingles with its item and 9.7 of 64 bits differ on average
# (deviation 2.9); two windows in a thousand exceed 18 bits there, at 0.85 one in a million.
RADIUS, BLOCKS = 18, 7
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 2_000_000  # narrow rows; larger tables are joined by shuffle
LANES, LANE_BITS = 32, 2  # 64 bit counts in 32 sums of two 32-bit lanes
BOUNDS = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def words_of(text: Column) -> Column:
    """Lower-cased runs of digits, a-z and non-ASCII characters."""
    return F.array_remove(F.split(lower_az(text), SEPARATORS), "")


def once(value: Column, fn) -> Column:
    """``fn`` of ``value`` as a bound variable: the planner cannot copy ``value`` into every use of it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def grams_of(words: Column, k: int) -> Column:
    """Hashes of the ``k`` words from each position on; fewer words give one hash of all, none nothing."""
    return once(words, lambda w: _grams(w, k))


def _grams(words: Column, k: int) -> Column:
    n = F.size(words)
    at = lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k)))
    return (
        F.when(n == 0, F.array().cast("array<long>"))
        .when(n < k, F.array(F.xxhash64(*(F.get(words, F.lit(j)) for j in range(k)))))
        .otherwise(F.transform(F.sequence(F.lit(0), n - k), at))
    )


def _fingerprints(grams: DataFrame, keys: list[str]) -> DataFrame:
    """One SimHash ``fp`` per key from rows (keys, gram): bits set in over half the grams."""
    lane = F.lit(0x0000000100000001)
    sums = grams.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *(F.sum(F.shiftrightunsigned("gram", j).bitwiseAND(lane)).alias(f"s{j}") for j in range(LANES)),
    )
    fp = F.lit(0).cast("long")
    for j in range(LANES):
        low = c(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{j}", 32)
        for half, bit in ((low, j), (high, j + 32)):
            value = -(1 << 63) if bit == 63 else 1 << bit
            fp = fp.bitwiseOR(F.when(half * 2 > c("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("fp"))


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BOUNDS[i]).bitwiseAND(F.lit((1 << (BOUNDS[i + 1] - BOUNDS[i])) - 1))


def _blocks(fp: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), _block(fp, i).alias("value")) for i in range(BLOCKS)))


def _block_balls(fp: Column) -> Column:
    """Every block value that differs from the own one in at most RADIUS // BLOCKS bits."""
    def ball(i: int) -> Column:
        bits = range(BOUNDS[i + 1] - BOUNDS[i])
        masks = [sum(1 << b for b in some) for r in range(RADIUS // BLOCKS + 1) for some in combinations(bits, r)]
        own = _block(fp, i)
        return F.transform(
            F.array(*(F.lit(m).cast("long") for m in masks)),
            lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("value")))

    return F.concat(*map(ball, range(BLOCKS)))


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """doc_id, text_hash, item_id, start, similarity: the best window for each document and item.

    ``start`` is the window's first word. A document shorter than an item is one window. Items and
    documents without words match nothing; items that repeat an id count each text on its own; rows
    that repeat a doc_id are told apart by ``text_hash`` (rows equal in both are one). A null id is an id
    like any other. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    prepare(spark)
    words = words_of(c(item_text))
    bench = items.select(c(item_id).alias("id"), words.alias("w")).where(F.size("w") > 0).select(
        F.struct(c("id"), F.xxhash64("w").alias("h")).alias("item"), "w", F.least(F.size("w"), F.lit(WORDS)).alias("k")
    ).dropDuplicates(["item"])
    lengths = sorted(r.k for r in bench.select("k").distinct().collect())  # at most five numbers
    if not lengths:
        lengths = [WORDS]
    pick = lambda w: F.coalesce(*(F.when(c("k") == k, grams_of(w, k)) for k in lengths))
    bench = materialise(bench.select("item", "k", pick(c("w")).alias("grams")).withColumn("size", F.size("grams")), "items")

    own = docs.select(
        F.struct(c(doc_id).alias("id"), F.xxhash64(lower_az(c(text))).alias("h")).alias("doc"),
        words_of(c(text)).alias("w"))
    item_grams = bounded(bench.select("item", "k", "size", F.explode("grams").alias("gram")).distinct())
    # shingles of k words, all positions; what holds no shingle of any item ends at this join
    per_length = [own.select("doc", F.lit(k).alias("k"), grams_of(c("w"), k).alias("grams")) for k in lengths]
    # the size is taken before the explode, which else would carry the whole array along with every element;
    # the outer form keeps the planner from computing the array a second time to test that it has elements
    exploded = [x.withColumn("m", F.size("grams")).select("doc", "k", "m", F.posexplode_outer("grams").alias("p", "gram")) for x in per_length]
    every = exploded[0]
    for x in exploded[1:]:
        every = every.unionByName(x)
    hits = every.join(item_grams, ["k", "gram"])
    last = F.greatest(c("m") - c("size"), F.lit(0))
    first = F.least(F.greatest(c("p") - c("size") + 1, F.lit(0)), last)
    spans = hits.select("doc", "item", "k", "size", first.alias("lo"), F.least(c("p"), last).alias("hi")).distinct()
    spans = materialise(spans, "spans")

    named = bounded(spans.select("doc").distinct(), BROADCAST_ROWS // 2)
    texts = own.join(named, "doc", "left_semi").dropDuplicates(["doc"])
    texts = materialise(texts.select("doc", F.explode(F.array(*(
        F.struct(F.lit(k).alias("k"), grams_of(c("w"), k).alias("grams")) for k in lengths))).alias("x")).select("doc", "x.k", "x.grams"), "texts")
    starts = spans.select("doc", "item", "k", "size", F.explode(F.sequence("lo", "hi")).alias("s")).distinct()

    def window_grams(windows: DataFrame) -> DataFrame:
        lists = windows.groupBy("doc", "item", "k", "size").agg(F.collect_list("s").alias("starts"))
        joined = lists.join(texts, ["doc", "k"]).select("doc", "item", "size", "grams", F.explode("starts").alias("s"))
        return joined.select("doc", "item", "s", F.explode(F.slice("grams", c("s") + 1, c("size"))).alias("gram"))

    prints = _fingerprints(window_grams(starts), ["doc", "item", "s"])
    item_prints = materialise(_fingerprints(bench.select("item", F.explode("grams").alias("gram")), ["item"]), "prints")
    balls = item_prints.select("item", c("fp").alias("item_fp"), F.explode(_block_balls(c("fp"))).alias("b")).select("item", "item_fp", "b.*").distinct()
    near = (
        prints.select("doc", "item", "s", "fp", F.explode(_blocks(c("fp"))).alias("b")).select("doc", "item", "s", "fp", "b.*")
        .join(bounded(balls), ["item", "block", "value"])
        .where(F.bit_count(c("fp").bitwiseXOR(c("item_fp"))) <= RADIUS)
        .select("doc", "item", "s").distinct()
    )
    near = materialise(near.join(bounded(bench.select("item", "k", "size")), "item"), "candidates")

    left = window_grams(near).groupBy("doc", "item", "s", "gram").agg(F.count("*").alias("x"))
    right = bench.select("item", "size", F.explode("grams").alias("gram")).groupBy("item", "size", "gram").agg(F.count("*").alias("y"))
    sizes = left.groupBy("doc", "item", "s").agg(F.sum("x").alias("n"))
    common = left.join(bounded(right), ["item", "gram"]).groupBy("doc", "item", "s", "size").agg(F.sum(F.least("x", "y")).alias("both"))
    found = common.join(sizes, ["doc", "item", "s"]).select(
        "doc", "item", "s", (c("both") / (c("n") + c("size") - c("both"))).alias("similarity"))
    best = found.where(c("similarity") >= similarity).groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-c("s")).alias("s"))).alias("best"))
    return best.select(
        c("doc.id").alias("doc_id"), c("doc.h").alias("text_hash"), c("item.id").alias("item_id"),
        (-c("best.s")).cast("long").alias("start"), c("best.similarity").alias("similarity"))


def drop_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no window similar to a benchmark item, all columns kept."""
    with steps(docs.sparkSession) as keep:
        found = leaks(docs, items, doc_id, text, **options)
        lost = keep(found.select(c("doc_id").alias("__lost_id"), c("text_hash").alias("__lost_text")).distinct(), "leaks")
    lost = bounded(lost)
    same = c(doc_id).eqNullSafe(c("__lost_id")) & (F.xxhash64(lower_az(c(text))) == c("__lost_text"))
    return docs.join(lost, same, "left_anti")

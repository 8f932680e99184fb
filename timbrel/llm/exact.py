"""Exact duplicates with heavy hitters split off.

A Misra-Gries pass (``freqItems``, whose counters are bounded by 1 / support) names the digests that
may be frequent. Their exact counts and winners fit a table of at most 1 / support rows, which is
broadcast, so rows of hot groups are decided where they lie. All other digests, each at most
``support`` of the rows, meet by an ordinary shuffle of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import lower_az, prepare
from timbrel.session import materialise

c = F.col
SUPPORT = 0.001  # at most 1000 digests are heavy


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, digest) per row, written once: the texts are read a single time."""
    prepare(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), c(doc_id).alias("doc_id"),
        F.sha2(lower_az(c(text)).cast("binary"), 256).alias("digest"),
    )
    return materialise(rows, "digests")


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size")
    )


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with
    the largest doc_id stays; of rows that repeat it, one. A null doc_id is below every other.
    An empty table gives no rows; other columns are not looked at, whatever their names.
    """
    rows = digests(docs, doc_id, text)
    # bounded by 1 / support entries, false ones included; verified by exact counts below
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    frequent = materialise(frequent.where(c("digest").isNotNull()).distinct(), "frequent")
    heavy = materialise(_winners(rows.join(F.broadcast(frequent), "digest", "left_semi")), "heavy")
    light = rows.join(F.broadcast(frequent), "digest", "left_anti")
    decided = rows.join(F.broadcast(heavy), "digest").unionByName(light.join(_winners(light), "digest"))
    return decided.select(
        "doc_id", c("winner.doc_id").alias("keep_id"), "group_size",
        (c("row") == c("winner.row")).alias("kept"), c("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, unchanged.

    Only the losing (doc_id, digest) pairs are joined with the texts. Where a winner's doc_id and
    text are repeated as a whole, one of the repetitions stays.
    """
    decided = materialise(groups(docs, doc_id, text, support), "decided")
    lost = decided.where(~c("kept")).select(
        c("doc_id").alias("__lost_id"), c("text_sha256").alias("__lost_text")).distinct()
    again = decided.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    again = materialise(again.where("n > 1 and kept").select("doc_id", "text_sha256"), "repeated")
    key = F.sha2(lower_az(c(text)).cast("binary"), 256)
    repeats = not again.isEmpty()
    if repeats:
        lost = lost.join(again, (c("__lost_id").eqNullSafe(c("doc_id"))) & (c("__lost_text") == c("text_sha256")), "left_anti")
    kept = docs.join(lost, c(doc_id).eqNullSafe(c("__lost_id")) & (key == c("__lost_text")), "left_anti")
    if not repeats:
        return kept
    marked = kept.withColumn("__digest", key).join(
        again.select(c("doc_id").alias("__again_id"), c("text_sha256").alias("__again_text")),
        c(doc_id).eqNullSafe(c("__again_id")) & (c("__digest") == c("__again_text")), "left")
    once = marked.where(c("__again_text").isNotNull()).dropDuplicates(["__again_id", "__again_text"])
    return marked.where(c("__again_text").isNull()).unionByName(once).select(*[c(f"`{x}`") for x in docs.columns])

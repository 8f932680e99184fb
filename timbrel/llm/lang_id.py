"""Language identification by fusing evidence as a Bayesian would.

The posterior of a language is proportional to: a host prior, smoothed towards the prior of the
registered domain and that towards the global one; the likelihood of the declared markup language;
the likelihood of the address suffix; and the likelihood of the text under byte-trigram models. All
tables come from grouped aggregation over the whole input, with declarations as noisy labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import COUNTS, Tally, arrow_map, dense, utf8

c = F.col
LANGUAGES = ("en", "de", "fr", "es")
SIZE = 1 << 16  # buckets of hashed byte trigrams, the bound of a model
RELIABLE = 0.9  # how often a declaration is right
SMOOTH = 20.0  # declarations that a level takes from the level above
OVERLAP = 3.0  # a byte is seen by three trigrams
UNKNOWN = 0.001  # prior of a text in none of the languages
MIN_PROBABILITY = 0.5
BACKGROUND = -np.log(SIZE)


def trigrams(data: bytes) -> np.ndarray:
    """Hashed trigrams of the A-Z-lower-cased bytes, white space and ASCII symbols taken as one blank."""
    raw = np.frombuffer(data.translate(_FOLD), np.uint8).astype(np.uint32)
    if len(raw):
        raw = raw[np.flatnonzero((raw != 32) | (np.r_[np.uint32(0), raw[:-1]] != 32))]
    if len(raw) < 3 or not (raw != 32).any():
        return np.zeros(0, np.int64)
    mixed = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64)


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _declared_index(declared: Column, languages) -> Column:
    """Position of the declared primary language, -1 for none or another."""
    code = F.lower(F.element_at(F.split(F.trim(declared.cast("string")), "[-_]"), 1))
    return reduce(lambda rest, i: F.when(code == languages[i], i).otherwise(rest), range(len(languages)), F.lit(-1))


def text_models(rows: DataFrame, parts: int) -> np.ndarray:
    """log P(trigram | language), ``parts`` x SIZE, from the texts that declare a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts, SIZE)
        for b in batches:
            for part, data in zip(b[0].to_pylist(), b[1].to_pylist()):
                tally.add(part, trigrams(data))
        yield from tally.batches()

    n = dense(arrow_map(rows.where("said >= 0").select("said", "text"), count, COUNTS), parts, SIZE)
    total = n.sum(axis=1, keepdims=True)
    # languages that nobody declares get the flat model
    return np.log((n + 0.1) / (total + 0.1 * SIZE)).astype(np.float32)


def _levels(rows: DataFrame, languages) -> DataFrame:
    """(host, prior array): declarations per host, smoothed by domain and globally."""
    n = len(languages)
    counts = [F.sum(F.when(c("said") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(n)]
    hosts = rows.groupBy("host", "domain").agg(*counts)
    again = [F.sum(f"n{i}").alias(f"d{i}") for i in range(n)]
    domains = hosts.groupBy("domain").agg(*again)
    every = domains.agg(*(F.coalesce(F.sum(f"d{i}"), F.lit(0)).alias(f"g{i}") for i in range(n))).first()
    world = [(every[i] + 1.0) / (sum(every) + n) for i in range(n)]
    domain_total = sum((c(f"d{i}") for i in range(n)), F.lit(0))
    priors = F.array(*((c(f"d{i}") + SMOOTH * world[i]) / (domain_total + SMOOTH) for i in range(n)))
    host_total = sum((c(f"n{i}") for i in range(n)), F.lit(0))
    joined = hosts.join(domains.select(c("domain").alias("__domain"), priors.alias("up")), c("domain").eqNullSafe(c("__domain")))
    prior = F.array(*((c(f"n{i}") + SMOOTH * c("up")[i]) / (host_total + SMOOTH) for i in range(n)))
    return joined.select(c("host").alias("__host"), c("domain").alias("__domain"), prior.alias("__prior"))


def _suffixes(rows: DataFrame, languages) -> DataFrame:
    """(suffix, array of P(suffix | language)), add-one smoothed."""
    n = len(languages)
    counts = rows.where("suffix is not null").groupBy("suffix").agg(
        *(F.sum(F.when(c("said") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(n)))
    every = counts.agg(F.count("*"), *(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(n))).first()
    kinds = every[0] + 1
    odds = F.array(*((c(f"n{i}") + 1.0) / (every[i + 1] + kinds) for i in range(n)))
    return counts.select(c("suffix").alias("__suffix"), odds.alias("__odds"))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def identify(
    docs: DataFrame, text: Column, declared: Column, host: Column,
    address: bool = True, languages: tuple[str, ...] = LANGUAGES, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """The ``keep`` columns of ``docs`` (all by default) as a struct ``row``, with ``language``, ``probability`` and ``text_bytes``.

    ``address`` says that hosts are addresses whose last label is a suffix and whose last two are the
    registered domain; else hosts are plain names. Missing evidence (null or empty text, null or foreign
    declaration, null host) leaves the others to decide. A text that none of the models explains
    better than even noise is ``und``; so is one without letters when nothing else is known.
    Ties go to the language named first. Repeated rows get the same answer; no rows give none.
    """
    n = len(languages)
    labels = F.split(host, r"\.")
    domain = F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")) if address else F.lit(None).cast("string")
    suffix = F.when(F.size(labels) >= 2, F.element_at(labels, -1)) if address else F.lit(None).cast("string")
    facts = docs.select(
        F.struct(*(c(f"`{x}`") for x in (keep or docs.columns))).alias("row"), utf8(text).alias("text"),
        _declared_index(declared, languages).alias("said"), host.alias("host"),
        domain.alias("domain"), suffix.alias("suffix"))
    model = text_models(facts, n)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n * SIZE numbers, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.vstack([shared.value, np.full((1, SIZE), BACKGROUND, np.float32)])
        for b in batches:
            texts = b["text"].to_pylist()
            sums = []
            for t in texts:
                at = trigrams(t)
                # long texts by pieces, so that memory does not follow their length
                sums.append(sum((logs[:, at[i : i + 65536]].sum(axis=1, dtype=np.float64) for i in range(0, len(at), 65536)), np.zeros(n + 1)) / OVERLAP)
            kept = [b[x] for x in ("row", "said", "host", "domain", "suffix")]
            logged = pa.array([x.tolist() for x in sums], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(list(map(len, texts)), pa.int64()), logged],
                names=["row", "said", "host", "domain", "suffix", "text_bytes", "logs"])

    kind = facts.schema["row"].dataType.simpleString()
    scored = arrow_map(facts, score, f"row {kind}, said int, host string, domain string, suffix string, text_bytes long, logs array<double>")
    priors, odds = _levels(facts.drop("row", "text"), languages), _suffixes(facts.drop("row", "text"), languages)
    joined = (
        scored.join(priors, c("host").eqNullSafe(c("__host")) & c("domain").eqNullSafe(c("__domain")), "left")
        .join(odds, c("suffix") == c("__suffix"), "left")
    )
    def weight(i: int) -> Column:
        agrees = F.when(c("said") < 0, 0.0).when(c("said") == i, float(np.log(RELIABLE))).otherwise(float(np.log((1 - RELIABLE) / max(n - 1, 1))))
        return c("logs")[i] + agrees + F.log(c("__prior")[i]) + F.coalesce(F.log(c("__odds")[i]), F.lit(0.0))

    none = c("logs")[n] + float(np.log(UNKNOWN)) + F.when(c("said") >= 0, float(np.log(1 / n))).otherwise(0.0)
    weights = joined.withColumn("w", F.array(*map(weight, range(n)), none))
    top = weights.withColumn("top", F.array_max("w"))
    shares = F.aggregate("w", F.lit(0.0), lambda total, x: total + F.exp(x - c("top")))
    names = F.array(*map(F.lit, (*languages, "und")))
    return top.select(
        "row", F.element_at(names, F.array_position("w", c("top")).cast("int")).alias("language"),
        (1 / shares).alias("probability"), "text_bytes")


def accept(
    docs: DataFrame, text: str = "text", declared: str = "lang", source: str = "source",
    languages: tuple[str, ...] = LANGUAGES, least: float = MIN_PROBABILITY,
) -> DataFrame:
    """The rows of ``docs`` in one of ``languages`` with a probability of ``least`` or more, columns unchanged.

    A text without any bytes has no language and goes.
    """
    found = identify(docs, c(f"`{text}`"), c(f"`{declared}`"), c(f"`{source}`").cast("string"), False, languages)
    kept = found.where((c("language") != "und") & (c("probability") >= least) & (c("text_bytes") > 0))
    return kept.select(*(c("row").getField(x).alias(x) for x in docs.columns))

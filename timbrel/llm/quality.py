"""Quality by ordinal regression: cumulative links over hashed text features.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all grades and ordered thresholds t_k. The
model is fitted by full-batch Adam on a bounded sample of graded rows; every row of the corpus is
then scored by its expected grade and its tail probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.llm.common import arrow_map, utf8
from timbrel.session import materialise

c = F.col
BITS = 18
SIZE = 1 << BITS  # hashed features, the bound of the model
PER_GRADE = 3000  # graded rows per grade in the fit: the documented bound of the sample
SEEN = 4  # sample rows that a feature must occur in to get a weight
STEPS, RATE, DECAY = 400, 0.3, 1e-5
TAIL = 1  # select by P(grade > TAIL)


def _hash(kind: bytes, item: bytes) -> int:
    return xxhash.xxh3_64_intdigest(item, kind[0]) & (SIZE - 1)


_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


class Words(dict):
    """word -> hashed features of its letters and of its shape, filled on demand and bounded."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = word.translate(_SHAPE)
        runs = bytes(b for i, b in enumerate(shape) if i == 0 or b != shape[i - 1])[:12]
        value = (_hash(b"w", word.lower().strip(b".,;:!?")), _hash(b"s", runs))
        if len(word) <= 40:
            if len(self) >= 500_000:
                self.clear()
            self[word] = value
        return value


_words = Words()


def features(data: bytes) -> np.ndarray:
    """Distinct hashed features of a whole text, sorted: words, word shapes, and shares in tenths."""
    words = data.split()
    kinds = set(words)
    lines = data.split(b"\n")
    size = max(len(data), 1)
    plain = data.translate(_SHAPE)
    shares = {
        b"distinct words": len(kinds) / max(len(words), 1),
        b"distinct lines": len(set(lines)) / len(lines),
        b"letters": plain.count(b"a") / size,
        b"capitals": plain.count(b"A") / size,
        b"blanks": data.count(b" ") / size,
    }
    whole = [_hash(b"t", b"%s %d" % (k, int(v * 10))) for k, v in shares.items()]
    whole.append(_hash(b"t", b"length %d" % len(words).bit_length()))
    found = list(chain(chain.from_iterable(map(_words.__getitem__, kinds)), whole))
    return np.unique(np.array(found, np.int64))


@dataclass
class Model:
    weights: np.ndarray  # SIZE numbers, zero for features not fitted
    known: np.ndarray
    thresholds: np.ndarray  # ascending

    def margin(self, at: np.ndarray) -> float:
        at = at[self.known[at]]
        return float(self.weights[at].sum() / np.sqrt(max(len(at), 1)))

    def tails(self, margin: float) -> np.ndarray:
        """P(grade > k) for every k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - margin, -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int) -> Model:
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=SIZE)
    known = seen >= SEEN
    rows = [r[known[r]] for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    columns, at = np.unique(flat, return_inverse=True)
    value = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1))
    share = np.bincount(grades, minlength=levels) + 1.0
    above = np.cumsum(share[::-1])[::-1][1:] / share.sum()
    first = -np.log(above / (1 - above))
    # the first threshold is free, the others follow by positive steps
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3)), np.zeros(len(columns))])
    over = grades[:, None] > np.arange(levels - 1)[None, :]
    balance = ((share.sum() / (levels * share)) ** 0.75)[grades]  # rare grades count more
    moment, scale = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        cuts = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1 : levels - 1]))])
        w = free[levels - 1 :]
        margin = np.bincount(owner, w[at], minlength=len(rows)) * value
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - margin[:, None], -500, 500)))
        # likelihood of a grade is the difference of neighbouring tails
        full = np.hstack([np.ones((len(rows), 1)), p, np.zeros((len(rows), 1))])
        slope = np.hstack([np.zeros((len(rows), 1)), p * (1 - p), np.zeros((len(rows), 1))])
        i = np.arange(len(rows))
        like = np.maximum(full[i, grades] - full[i, grades + 1], 1e-9)
        d_margin = -balance * (slope[i, grades] - slope[i, grades + 1]) / like
        d_cut = np.zeros_like(over, float)
        lo, hi = grades > 0, grades < levels - 1
        d_cut[i[lo], grades[lo] - 1] += (balance * slope[i, grades] / like)[lo]
        d_cut[i[hi], grades[hi]] -= (balance * slope[i, grades + 1] / like)[hi]
        cut_sum = d_cut.sum(axis=0)
        later = np.cumsum(cut_sum[::-1])[::-1]
        gradient = np.concatenate([
            later[:1], later[1:] * np.exp(free[1 : levels - 1]),
            np.bincount(at, (d_margin * value)[owner], minlength=len(columns)) + DECAY * len(rows) * w,
        ]) / max(len(rows), 1)
        moment = 0.9 * moment + 0.1 * gradient
        scale = 0.999 * scale + 0.001 * gradient**2
        free -= RATE * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(SIZE)
    weights[columns] = free[levels - 1 :]
    return Model(weights, known, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1 : levels - 1]))]))


def sample(graded: DataFrame, levels: int, per_grade: int = PER_GRADE) -> DataFrame:
    """At most ``per_grade`` rows (doc_id, grade) of each grade, by a stable hash order."""
    parts = [
        graded.where(c("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade) for g in range(levels)
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def train(docs: DataFrame, graded: DataFrame, levels: int, doc_id: str = "doc_id", text: str = "text", per_grade: int = PER_GRADE) -> Model:
    """Fits on the sampled rows. ``graded`` has (doc_id, grade 0..levels-1); rows with a null in either do not count."""
    some = sample(graded.where("doc_id is not null").where(c("grade").between(0, levels - 1)), levels, per_grade)
    some = materialise(some.select(c("doc_id").alias("__id"), c("grade").cast("int").alias("__grade")), "graded")
    picked = docs.join(F.broadcast(some), c(doc_id) == c("__id"))  # levels * per_grade rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t).astype(np.int32) for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(found, pa.list_(pa.int32()))], names=["grade", "at"])

    table = arrow_map(picked.select(c("__grade").alias("grade"), utf8(c(text)).alias("text")), run, "grade int, at array<int>").toArrow()
    rows = [np.asarray(x, np.int64) for x in table["at"].to_pylist()]
    # the order of rows decides the last digits of sums, so it is fixed
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes()))
    grades = np.array(table["grade"].to_pylist(), np.int64)
    return fit([rows[i] for i in order], grades[order] if len(order) else grades, levels)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", tail: int = TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept: one row per row of ``docs``.

    ``tail_probability`` is P(grade > tail); ``kept`` says that it is one half or more. Null counts as
    empty; an empty text is graded by the thresholds and its shares alone; repeated rows get a row each.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            tails = [own.tails(own.margin(features(t))) for t in b[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b[0], pa.array([float(x.sum()) for x in tails], pa.float64()),
                pa.array([float(x[tail]) for x in tails], pa.float64()),
                pa.array([bool(x[tail] >= 0.5) for x in tails], pa.bool_()),
            ], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(c(doc_id).alias("doc_id"), utf8(c(text)).alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")

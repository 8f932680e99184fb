"""What several corpus operators share: settings, exact lower-casing, Arrow mapping, hashed counts."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Arrow batches stay small whatever the length of texts; the rest lets Spark split hot join keys.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def lower_az(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed; null gives the empty text.

    For pure ASCII the built-in ``lower`` does just that and is much faster than ``translate``.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(text: Column) -> Column:
    """The bytes of a text; null gives no bytes."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema
    )


def byte_lists(values: list[bytes], kind=pa.binary()) -> pa.Array:
    return pa.array(values, kind)


COUNTS = "part int, bucket int, n long"
_COUNTS = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])


class Tally:
    """Counts of hashed items in dense arrays, one per part, that a task sends on when it ends.

    ``size`` bounds every array, so a task holds ``parts * size`` numbers however much it reads.
    """

    def __init__(self, parts: int, size: int):
        self.counts = np.zeros((parts, size), np.int64)

    def add(self, part: int, buckets: np.ndarray) -> None:
        if len(buckets) < self.counts.shape[1] // 8:
            np.add.at(self.counts[part], buckets, 1)
        else:
            self.counts[part] += np.bincount(buckets, minlength=self.counts.shape[1])

    def batches(self, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        for part, row in enumerate(self.counts):
            at = np.flatnonzero(row)
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                yield batch(_COUNTS, np.full(len(some), part, np.int32), some.astype(np.int32), row[some])


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("part", "bucket").agg(F.sum("n").alias("n"))


def dense(counts: DataFrame, parts: int, size: int) -> np.ndarray:
    """The summed counts as one array; its ``parts * size`` numbers are the bound of what comes here."""
    out = np.zeros((parts, size), np.int64)
    table = summed(counts).toArrow()
    out[table["part"].to_numpy(), table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table, and the files of the shuffles behind it given back.

    Spark deletes a shuffle's files when the driver's collector finds that nothing refers to it any more, by
    itself only every half hour (``spark.cleaner.periodicGC.interval``); a job of many levels asks after each one:
    twice, since what the first collection frees, and listeners told of the query's end, held on to it.
    """
    out = materialise(df, name)
    gc.collect()
    for _ in range(2):
        time.sleep(0.3)
        df.sparkSession._jvm.java.lang.System.gc()
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table; the driver collects its garbage once, so that plans of many steps do not pile up."""
    out = materialise(df, name)
    df.sparkSession._jvm.java.lang.System.gc()
    return out

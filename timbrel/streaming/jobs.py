"""Structured Streaming jobs over event tables.

Every job is a function of a streaming DataFrame; ``run`` drives one to the end of the
available input into an idempotent per-batch sink and returns what was written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timbrel.operators.ordered import dense_index, neighbourhood, position_block, prefix
from timbrel.operators.patients import last_wins, with_drift
from timbrel.session import configure
from timbrel.sources.tables import scratch


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder, asked of the file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def read_events(
    spark: SparkSession, folder: str, name: str = "events", files: int | None = None
) -> DataFrame:
    """Stream over the parquet files of a table, stored as one file or as a folder of parts.

    ``ts`` becomes a zoned timestamp (UTC). ``files`` per trigger bound a micro-batch.
    """
    files = files or FILES_PER_TRIGGER
    configure(spark)
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    # a stream watches a folder: that of the table's part files, or the one that holds its single file
    raw = reader.parquet(path) if is_folder(spark, path) else (
        reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder))
    if "ts" not in raw.columns:
        return raw
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return raw.withColumn("us", us).withColumn("ts", F.col("ts").cast("timestamp"))


FILES_PER_TRIGGER = 64


def batch_sink(path: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Write each micro-batch to its own folder: a replayed batch replaces itself."""

    def write(df: DataFrame, batch_id: int) -> None:
        out = prepare(df) if prepare else df
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run(
    stream: DataFrame, mode: str, name: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run to the end of the input; rows come back with their ``batch`` number."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", scratch(spark, f"{name}-progress"))
        .trigger(availableNow=True)
        .foreachBatch(batch_sink(path, prepare))
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest update of every key."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return best.select(*keys, "_r.*")


# --- windows -----------------------------------------------------------------------------------


def window_levels(
    events: DataFrame, value: Column, size: str, slide: str | None = None, key: str = "client",
    late: str | None = None, limit: float = 0.05,
) -> DataFrame:
    """Per key and (sliding or tumbling) window: rows, energy, warning above the limit.

    Every row counts, however late it comes, unless ``late`` says after what delay a window is
    closed for good; only then does its state end.
    """
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    timed = events.withWatermark("ts", late) if late and events.isStreaming else events
    level = F.sqrt(F.avg(value * value))
    return timed.groupBy(key, span.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), level.alias("level")
    ).select(
        key, F.unix_micros("w.start").alias("start_us"), "n", "level",
        (F.col("level") > limit).alias("warn"),
    )


def split_sessions(sessions: DataFrame, key: str, min_s: float, cap_s: float) -> DataFrame:
    """(key, start_us, seconds): sessions cut at the cap, short pieces left out."""
    length = F.col("last_us") - F.col("first_us")
    cap = int(cap_s * 1e6)
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(length / cap)))
    cut = sessions.select(key, "first_us", "last_us", pieces.alias("i"))
    start = F.col("first_us") + F.col("i") * cap
    seconds = F.least(F.lit(cap), F.col("last_us") - start) / 1e6
    return cut.select(key, start.alias("start_us"), seconds.alias("seconds")).filter(
        F.col("seconds") >= min_s
    )


def session_stream(events: DataFrame, gap: str, key: str = "client", late: str | None = None):
    """Open-ended activity per key, closed by a pause: (key, first_us, last_us).

    Late rows join or merge sessions, unless ``late`` limits the delay.
    """
    timed = events.withWatermark("ts", late) if late and events.isStreaming else events
    return timed.groupBy(key, F.session_window("ts", gap).alias("s")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us")
    ).select(key, "first_us", "last_us")


def sessions(
    events: DataFrame, gap_s: float, block: Column, key: str = "client", ident: str = "event_id"
) -> DataFrame:
    """The same sessions of a finished table, with a busy key spread over many tasks."""
    placed = dense_index(events.select(key, "us", ident), [key], block, ["us", ident], "_t")

    def build(w):
        return {"_prev": F.lag("us").over(w)}

    near = neighbourhood(placed, [key], "_t", 1, 0, build)
    opens = F.coalesce(F.col("us") - F.col("_prev") >= int(gap_s * 1e6), F.lit(True))
    numbered = prefix(
        near, [key], position_block("_t"), ["_t"], sums={"_s": opens.cast("long")}
    )
    return numbered.groupBy(key, "_s").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us")
    ).drop("_s")


def sticky_flag(events: DataFrame, flag: Column, key: str = "client") -> DataFrame:
    """Whether the flag was ever set for the key so far."""
    return events.groupBy(key).agg(F.max(flag).alias("seen"), F.count(F.lit(1)).alias("n"))


def unique_within(events: DataFrame, ident: str, keep: str = "1 hour") -> DataFrame:
    """Drop repeated ids; an id is forgotten once it is older than ``keep``."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark([ident])


# --- state --------------------------------------------------------------------------------------


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - float(a @ b) / ((np.linalg.norm(a) + 1e-10) * (np.linalg.norm(b) + 1e-10))


def follow_baseline(
    key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Drift of each screening from the patient's first one, which is kept for good."""
    # one patient's rows of one micro-batch, whose size the trigger limits
    rows = pd.concat(list(frames)).sort_values(["us", "screening_id"])
    base = np.asarray(state.get[0], dtype=np.float64) if state.exists else None
    first, drift = [], []
    for vector in rows["embedding"]:
        v = np.asarray(vector, dtype=np.float64)
        first.append(base is None)
        if base is None:
            base = v
            state.update((v.tolist(),))
        drift.append(0.0 if first[-1] else _distance(v, base))
    yield pd.DataFrame(
        {
            "patient_id": key[0], "screening_id": rows["screening_id"].to_numpy(),
            "drift": drift, "is_first": first,
        }
    )


def drift_stream(screenings: DataFrame) -> DataFrame:
    """(patient_id, screening_id, drift, is_first) from (.., .., us, embedding)."""
    return screenings.groupBy("patient_id").applyInPandasWithState(
        follow_baseline,
        "patient_id long, screening_id long, drift double, is_first boolean",
        "baseline array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


# --- tables fed by streams -----------------------------------------------------------------------


def upsert_stream(stream: DataFrame, name: str, ident: str, order: Sequence[str]) -> DataFrame:
    """Last-wins table: every batch adds its own newest rows, reading keeps the newest of all.

    Nothing already written is rewritten; ``last_wins`` over the folder also serves to compact.
    """
    written = run(stream, "append", name, prepare=lambda df: last_wins(df, ident, order))
    return last_wins(written.drop("batch"), ident, order)


def screen_stream(
    arriving: DataFrame, baselines: DataFrame, decide: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Arriving screenings joined with the static baselines, then audited and fused."""
    return decide(with_drift(arriving, baselines))

"""Token-bucket admission per key, as a batch job and as a stateful stream.

The first request of a key fills the bucket and is not charged. Later ones refill by the
elapsed time and are admitted while a whole token is there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timbrel.operators.ordered import dense_index, neighbourhood, position_block, prefix


def take(tokens: float, elapsed: float, rate: float, capacity: float) -> tuple[bool, float]:
    """(admitted, tokens left) for one request."""
    tokens = min(capacity, tokens + elapsed * rate)
    return (True, tokens - 1.0) if tokens >= 1.0 else (False, tokens)


def admit(
    requests: DataFrame, rate: float, capacity: float, block, key: str = "client",
    order: Sequence[str] = ("us", "event_id"),
) -> DataFrame:
    """Attach ``admitted``.

    After a pause long enough to fill the bucket the past no longer matters. Keys are cut at
    those pauses, so even a very busy key spreads over many tasks, and the fold itself streams
    through sorted partitions with one bucket in memory.
    """
    us, ident = order
    placed = dense_index(requests.select(key, us, ident), [key], block, list(order), "_t")

    def build(w):
        return {"_gap": (F.col(us) - F.lag(us).over(w)) / 1e6}

    gaps = neighbourhood(placed, [key], "_t", 1, 0, build)
    cut = F.coalesce(F.col("_gap") * rate >= capacity, F.lit(True)).cast("long")
    parts = prefix(gaps, [key], position_block("_t"), ["_t"], sums={"_part": cut})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = None, capacity, 0
        for batch in batches:
            flags = []
            for k, part, t, now in zip(
                batch[key], batch["_part"], batch["_t"], batch[us], strict=True
            ):
                if (k, part) != current:
                    current, tokens = (k, part), capacity
                    ok, tokens = (True, capacity) if t == 0 else take(capacity, 0.0, rate, capacity)
                else:
                    ok, tokens = take(tokens, (now - last) / 1e6, rate, capacity)
                last = now
                flags.append(ok)
            yield pd.DataFrame({key: batch[key], ident: batch[ident], "admitted": flags})

    return (
        parts.select(key, "_part", "_t", us, ident)
        .repartition(key, "_part")
        .sortWithinPartitions(key, "_part", "_t")
        .mapInPandas(fold, f"{key} long, {ident} long, admitted boolean")
    )


def admit_stream(
    requests: DataFrame, rate: float, capacity: float, ttl_ms: int | None = None
) -> DataFrame:
    """Streaming form over (client, us, event_id): (client, event_id, admitted).

    State per client is the token count and the time of its last request. A bucket idle for
    long enough is full again, so the state may expire after ``ttl_ms``; an expired client
    starts as a new one.
    """

    def fold(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        # one client's rows of one micro-batch, whose size the trigger limits
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        tokens, last = state.get if state.exists else (capacity, None)
        flags = []
        for now in rows["us"]:
            if last is None:
                ok = True
            else:
                ok, tokens = take(tokens, (now - last) / 1e6, rate, capacity)
            last = int(now)
            flags.append(ok)
        state.update((float(tokens), last))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(
            {"client": key[0], "event_id": rows["event_id"].to_numpy(), "admitted": flags}
        )

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return requests.groupBy("client").applyInPandasWithState(
        fold, "client long, event_id long, admitted boolean", "tokens double, last long",
        "append", timeout,
    )

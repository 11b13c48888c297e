"""Keyed state processors over a call stream: token bucket and call quotas.

State per key is a few numbers, kept by Spark's state store and dropped when a key falls idle.
Within a micro-batch calls of a key are put in order of time; across batches the stream is expected
in order, as the batch operators in ``operators`` see it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.buckets import consume
from ..operators.logs import DAY_CAP, DECISION, THREAD_CAP

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts_us", "call_id"])


class BucketProcessor(StatefulProcessor):
    """Token bucket per key.

    After a window of idle time the bucket is full again, so a timer on the watermark may drop it.
    """

    def __init__(self, requests: int, window_us: int):
        self.requests = requests
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens bigint, last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = _in_order(rows)
        full = self.requests * self.window_us
        held = self.bucket.get() if self.bucket.exists() else None
        tokens, last = held if held else (full, int(calls["ts_us"].iloc[0]))
        allowed, left = [], []
        for t in calls["ts_us"].tolist():
            tokens, ok = consume(tokens, max(0, t - last), self.requests, self.window_us)
            last = max(last, t)  # a late call adds no time
            allowed.append(ok)
            left.append(tokens)
        self.bucket.update((int(tokens), int(last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.window_us) // 1000 + 1)
        out = calls[["key", "call_id", "ts_us"]].copy()
        out["allowed"], out["tokens"] = allowed, left
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter([])

    def close(self) -> None:
        pass


def token_bucket_stream(
    calls: DataFrame, requests: int, window_us: int = 60_000_000, lateness: str = "10 minutes"
) -> DataFrame:
    """Streaming form of ``token_bucket``: calls (key, call_id, ts, ts_us)."""
    key_type = calls.schema["key"].dataType.simpleString()
    id_type = calls.schema["call_id"].dataType.simpleString()
    return (
        calls.select("key", "call_id", "ts_us", F.col("ts").cast("timestamp").alias("ts"))
        .withWatermark("ts", lateness)
        .groupBy("key")
        .transformWithStateInPandas(
            BucketProcessor(requests, window_us),
            f"key {key_type}, call_id {id_type}, ts_us bigint, allowed boolean, tokens bigint",
            "append",
            "EventTime",
        )
    )


class QuotaProcessor(StatefulProcessor):
    """Caps per thread and per tenant and day, keyed by (tenant, day).

    The day is over once the watermark passes its end: a timer then drops all its state.
    """

    def __init__(self, thread_cap: int, day_cap: int):
        self.thread_cap = thread_cap
        self.day_cap = day_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.day_calls = handle.getValueState("day_calls", "n bigint")
        self.threads = handle.getMapState("threads", "thread_id string", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = _in_order(rows)
        n_day = self.day_calls.get()[0] if self.day_calls.exists() else 0
        decisions = []
        for thread in calls["thread_id"].tolist():
            held = self.threads.getValue((thread,)) if self.threads.containsKey((thread,)) else None
            n_thread = held[0] if held else 0
            if n_thread + 1 > self.thread_cap:
                decisions.append(DECISION["thread"])
            elif n_day + 1 > self.day_cap:
                decisions.append(DECISION["tenant"])
            else:
                n_day += 1
                self.threads.updateValue((thread,), (n_thread + 1,))
                decisions.append("ADMITTED")
        self.day_calls.update((n_day,))
        day_end_ms = int((calls["ts_us"].iloc[-1] // 86_400_000_000 + 1) * 86_400_000)
        self.handle.registerTimer(day_end_ms)
        out = calls[["call_id", "thread_id", "tenant_id"]].copy()
        out["decision"] = decisions
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.day_calls.clear()
        self.threads.clear()
        return iter([])

    def close(self) -> None:
        pass


def quota_stream(
    calls: DataFrame,
    thread_cap: int = THREAD_CAP,
    day_cap: int = DAY_CAP,
    lateness: str = "1 hour",
) -> DataFrame:
    """Streaming caps per thread and per (tenant, day): calls with ``decision``.

    The cap over all tenants of a day is a single counter and is left to the batch form.
    """
    id_type = calls.schema["call_id"].dataType.simpleString()
    return (
        calls.select(
            "call_id", "thread_id", "tenant_id", "day", "ts_us", F.col("ts").cast("timestamp").alias("ts")
        )
        .withWatermark("ts", lateness)
        .groupBy("tenant_id", "day")
        .transformWithStateInPandas(
            QuotaProcessor(thread_cap, day_cap),
            f"call_id {id_type}, thread_id string, tenant_id string, decision string",
            "append",
            "EventTime",
        )
    )

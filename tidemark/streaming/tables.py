"""Streaming forms that need no custom state: usage, latest runs, manifests, results, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.logs import RETENTION_DAYS, retain


def usage_stream(calls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Calls per tenant and UTC day; a day is emitted when the watermark closes it."""
    return (
        calls.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "tenant_id")
        .agg(F.count(F.lit(1)).alias("n_calls"))
        .select(F.to_date("window.start").alias("day"), "tenant_id", "n_calls")
    )


def latest_runs_stream(runs: DataFrame) -> DataFrame:
    """Latest run per thread, for update mode."""
    return (
        runs.groupBy("thread_id")
        .agg(F.max(F.struct("seq", "error_code", "response")).alias("_run"))
        .select("thread_id", "_run.*")
    )


BatchWriter = Callable[[DataFrame, int], None]


def manifest_writer(path: str) -> BatchWriter:
    """``foreachBatch`` sink that appends loads to a manifest table, once per micro-batch.

    Each batch owns one folder, so a batch that is replayed after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def result_writer(path: str, key: list[str]) -> BatchWriter:
    """``foreachBatch`` sink for results: the newest row per key of a batch, one folder per batch.

    Readers take the newest row per key over all folders (``result_reuse`` does).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        ordered = ["written_at", *[c for c in rest if c != "written_at"]]
        newest = (
            batch.groupBy(*key)
            .agg(F.max(F.struct(*ordered)).alias("_r"))
            .select(*key, "_r.*")
        )
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def retention_writer(path: str, ts: str, as_of: str, days: int = RETENTION_DAYS) -> BatchWriter:
    """``foreachBatch`` sink that keeps only rows inside the retention period."""

    def write(batch: DataFrame, batch_id: int) -> None:
        retain(batch, ts, as_of, days).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write

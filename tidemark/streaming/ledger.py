"""Streams whose decisions hang on all calls before: the batch operators on each micro-batch.

What a micro-batch leaves behind (calls used up per scope, tokens left per key) is written next to its
decisions, and the next one starts from it.  So a hot thread, tenant, day or key is worked on by as many
tasks as in the batch operators, counters of threads survive the day, and the cap over all tenants holds.

Everything a batch writes lies in folders with its number, and it only reads what earlier batches wrote:
a batch that is replayed after a failure replaces itself.  A batch writes what has changed only; every
``compact_every`` batches these changes are put together.  Folders of batches before the last but one such
point are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.buckets import SLICE_ROWS, token_bucket
from ..operators.quotas import SCOPES, Caps, admit
from .tables import BatchWriter

LATE = "LATE"
COUNTERS = "scope string, thread_id string, tenant_id string, day date, n_used bigint"


class Changes:
    """Rows that batches leave behind, read as those of all batches before a given one.

    ``merge`` turns the rows of several batches into one row per key.
    """

    def __init__(self, path: str, schema: str, merge, compact_every: int):  # noqa: ANN001
        self.path, self.schema, self.merge, self.every = path, schema, merge, compact_every

    def _folders(self, before: int, start: int) -> list[str]:
        whole = [f"{self.path}/upto={start}"] if start else []
        return whole + [f"{self.path}/batch={i}" for i in range(start, before)]

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return self.merge(spark.read.schema(self.schema).parquet(*folders))

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What all batches before this one have left, one row per key."""
        start = batch_id - batch_id % self.every
        if start and start == batch_id:
            earlier = self._folders(start, start - self.every)
            self._read(spark, earlier).write.mode("overwrite").parquet(f"{self.path}/upto={start}")
        return self._read(spark, self._folders(batch_id, start))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def _counters(keep_days: int):  # noqa: ANN202
    def merge(rows: DataFrame) -> DataFrame:
        """Sums per scope; days that are over by more than ``keep_days`` go."""
        newest = rows.agg(F.max("day").alias("newest")).scalar()
        keys = ["scope", "thread_id", "tenant_id", "day"]
        kept = rows.filter(F.col("day").isNull() | (F.datediff(newest, "day") <= keep_days))
        return kept.groupBy(*keys).agg(F.sum("n_used").alias("n_used"))

    return merge


def _own(counters: DataFrame, calls: DataFrame, scope: str) -> DataFrame:
    """The counters of the scopes that a batch touches."""
    keys = SCOPES[scope]
    touched = calls.select(*keys).distinct()
    return (
        counters.filter(F.col("scope") == scope).select(*keys, "n_used").join(touched, keys, "left_semi")
    )


def quota_writer(
    path: str, caps: Caps | None = None, keep_days: int = 2, compact_every: int = 50
) -> BatchWriter:
    """``foreachBatch`` sink of call quotas: decisions of batch i in ``path``/decisions/batch=i.

    Within a batch calls count in order of time, and batches in their order.  A late call counts for its own
    day, but only up to ``keep_days`` days before the newest day of earlier batches: from then on the day's
    counters are gone, the decision is LATE, and the call counts nowhere.
    """
    caps = caps or Caps()
    store = Changes(f"{path}/counters", COUNTERS, _counters(keep_days), compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counters = store.before(spark, batch_id)
        newest = counters.agg(F.max("day")).first()[0]
        too_late = F.lit(False) if newest is None else F.datediff(F.lit(newest), "day") > keep_days
        calls = batch.select("call_id", "ts_us", "day", "thread_id", "tenant_id")
        in_time = calls.filter(~F.coalesce(too_late, F.lit(False)))
        used = {scope: _own(counters, in_time, scope) for scope in SCOPES}
        decided = admit(in_time, caps, used).unionByName(
            calls.filter(too_late).withColumn("decision", F.lit(LATE))
        )
        folder = f"{path}/decisions/batch={batch_id}"
        decided.write.mode("overwrite").parquet(folder)
        admitted = spark.read.schema(decided.schema).parquet(folder).filter("decision = 'ADMITTED'")
        store.add(reduce(DataFrame.unionByName, [_changes(admitted, s) for s in SCOPES]), batch_id)

    return write


def _changes(admitted: DataFrame, scope: str) -> DataFrame:
    keys = SCOPES[scope]
    counted = admitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used"))
    kinds = {"thread_id": "string", "tenant_id": "string", "day": "date"}
    columns = [F.col(c) if c in keys else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]
    return counted.select(F.lit(scope).alias("scope"), *columns, "n_used")


def bucket_writer(
    path: str,
    requests: int,
    window_us: int = 60_000_000,
    key_type: str = "string",
    slice_rows: int = SLICE_ROWS,
    compact_every: int = 50,
) -> BatchWriter:
    """``foreachBatch`` sink of token buckets: flags of batch i in ``path``/flags/batch=i.

    A hot key's calls of a batch are cut into slices, each reduced to its function in a task of its own
    (``operators.buckets``).  Keys that have been idle for a window have a full bucket and are forgotten.
    """

    def merge(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max("last_us").alias("newest")).scalar()
        last = rows.groupBy("key").agg(F.max(F.struct("batch", "tokens", "last_us")).alias("_last"))
        return last.select("key", "_last.*").filter(newest - F.col("last_us") < window_us)

    schema = f"key {key_type}, batch bigint, tokens bigint, last_us bigint"
    store = Changes(f"{path}/tokens", schema, merge, compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        calls = batch.select(F.col("key").cast(key_type).alias("key"), "call_id", "ts_us")
        held = store.before(spark, batch_id).join(calls.select("key").distinct(), "key", "left_semi")
        flags = token_bucket(calls, requests, window_us, slice_rows, held=held)
        folder = f"{path}/flags/batch={batch_id}"
        flags.write.mode("overwrite").parquet(folder)
        written = spark.read.schema(flags.schema).parquet(folder)
        # Calls at one moment were replayed in order of their ids.
        last = written.groupBy("key").agg(F.max(F.struct("ts_us", "call_id", "tokens")).alias("_last"))
        store.add(
            last.select(
                "key",
                F.lit(batch_id).cast("long").alias("batch"),
                F.col("_last.tokens").alias("tokens"),
                F.col("_last.ts_us").alias("last_us"),
            ),
            batch_id,
        )

    return write

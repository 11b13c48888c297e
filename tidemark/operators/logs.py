"""Operators over request logs and load manifests: quotas, freshness, reuse, latest state.

Log: key, call_id, ts, ts_us, day, thread_id, tenant_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Lifetimes and caps.
FINALIZED_TTL_SECONDS = 180 * 24 * 3600
PROVISIONAL_TTL_SECONDS = 6 * 3600
RESULT_TTL_SECONDS = 24 * 3600
RETENTION_DAYS = 90
THREAD_CAP = 20
DAY_CAP = 500

DECISION = {
    "thread": "THREAD_CAP",
    "tenant": "TENANT_DAY_CAP",
    "day": "DAY_CAP",
}


class ThreadSpansTenants(ValueError):
    """A thread is used by more than one tenant on one day, which the quota cascade excludes."""


def first_calls(log: DataFrame, scope: list[str], cap: int) -> DataFrame:
    """The first ``cap`` calls of each scope in arrival order.

    ``position <= cap`` lets Spark cut each scope down to ``cap`` rows per input partition before
    the shuffle, so a scope with a third of all calls, or a whole day, stays small.
    """
    order = Window.partitionBy(*scope).orderBy("ts_us", "call_id")
    return (
        log.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= cap)
    )


def check_threads(log: DataFrame) -> None:
    """Fail unless every thread stays within one tenant per day."""
    crossing = (
        log.groupBy("thread_id", "day")
        .agg(F.min("tenant_id").alias("a"), F.max("tenant_id").alias("b"))
        .filter("a <> b")
    )
    if not crossing.isEmpty():
        raise ThreadSpansTenants("a thread is used by several tenants on one day")


def _cutoffs(log: DataFrame, scope: list[str], cap: int, name: str) -> DataFrame:
    """Last admitted call of each scope that reaches its cap: a row only where the cap bites."""
    return (
        first_calls(log, scope, cap)
        .filter(F.col("position") == cap)
        .select(*scope, F.struct("ts_us", "call_id").alias(name))
    )


def _thread_cutoffs(log: DataFrame, cap: int, used: DataFrame) -> DataFrame:
    """Thread cutoffs when earlier days used a part of the cap; a spent thread is cut at once."""
    rest = F.lit(cap) - F.coalesce("n_used", F.lit(0))
    return (
        first_calls(log, ["thread_id"], cap)
        .join(used, "thread_id", "left")
        .filter(F.col("position") == F.greatest(rest, F.lit(1)))
        .select(
            "thread_id",
            F.struct(
                F.when(rest > 0, F.col("ts_us")).otherwise(F.lit(-1)).alias("ts_us"), "call_id"
            ).alias("thread_cut"),
        )
    )


def quota_admission(
    log: DataFrame,
    thread_cap: int = THREAD_CAP,
    day_cap: int = DAY_CAP,
    used: DataFrame | None = None,
    global_day_cap: int | None = None,
) -> DataFrame:
    """Calls with ``decision``: ADMITTED or the cap that refused it; a refused call counts nowhere.

    Caps hold per thread, per (tenant, day) and per day.  Each stage finds, among the survivors of
    the stage before, the last call that still fits its scope; calls after it are refused.  Once a
    day scope is full all its later calls fail anyway, so this equals one-by-one counting as long as
    a thread stays in one tenant a day (``check_threads``) and the log holds one day per thread.
    For threads that run over several days use ``admit_by_day``; it passes what earlier days used
    as ``used`` (thread_id, n_used).

    The log itself is never sorted or shuffled as a whole: only the pruned first calls are, and the
    cutoffs, one row per scope that reaches its cap, are joined back.
    """
    call = F.struct("ts_us", "call_id")

    def within(name: str, at: Column = call) -> Column:
        return F.col(name).isNull() | (at <= F.col(name))

    thread_cut = (
        _cutoffs(log, ["thread_id"], thread_cap, "thread_cut")
        if used is None
        else _thread_cutoffs(log, thread_cap, used)
    )
    at_thread = log.join(thread_cut, "thread_id", "left")
    survivors = at_thread.filter(within("thread_cut")).select(*log.columns)
    tenant_cut = _cutoffs(survivors, ["tenant_id", "day"], day_cap, "tenant_cut")
    survivors = (
        survivors.join(tenant_cut, ["tenant_id", "day"], "left")
        .filter(within("tenant_cut"))
        .select(*log.columns)
    )
    global_cap = day_cap if global_day_cap is None else global_day_cap
    day_cut = _cutoffs(survivors, ["day"], global_cap, "day_cut")
    # A cap is the reason only if its scope really filled up, that is if its last fitting call was
    # admitted by the later stages too; otherwise the later stage closed first and is the reason.
    thread_cut_call, tenant_cut_call = F.col("thread_cut"), F.col("tenant_cut")
    thread_full = within("tenant_cut", thread_cut_call) & within("day_cut", thread_cut_call)
    tenant_full = within("day_cut", tenant_cut_call)
    decision = (
        F.when(~within("thread_cut") & thread_full, F.lit(DECISION["thread"]))
        .when(~within("tenant_cut") & tenant_full, F.lit(DECISION["tenant"]))
        .when(~within("day_cut"), F.lit(DECISION["day"]))
        .otherwise(F.lit("ADMITTED"))
    )
    return (
        at_thread.join(tenant_cut, ["tenant_id", "day"], "left")
        .join(day_cut, ["day"], "left")
        .select(*log.columns, decision.alias("decision"))
    )


def admit_by_day(log: DataFrame, thread_cap: int = THREAD_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """``quota_admission`` for threads that run over days: one step per calendar day.

    Each step is a distributed job over that day's calls; what a thread has used is carried in a
    written table.
    """
    check_threads(log)
    spark = log.sparkSession
    used = spark.createDataFrame([], "thread_id string, n_used bigint")
    done = None
    for row in log.select("day").distinct().orderBy("day").toLocalIterator():
        today = materialize(
            quota_admission(log.filter(F.col("day") == row.day), thread_cap, day_cap, used)
        )
        done = today if done is None else done.unionByName(today)
        spent = (
            today.filter("decision = 'ADMITTED'")
            .groupBy("thread_id")
            .agg(F.count(F.lit(1)).alias("n_used"))
        )
        used = materialize(
            used.unionByName(spent).groupBy("thread_id").agg(F.sum("n_used").alias("n_used"))
        )
    return log.withColumn("decision", F.lit(None).cast("string")) if done is None else done


def quota_usage(log: DataFrame, thread_cap: int = THREAD_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """Calls per thread, per (tenant, day) and per day against their caps."""

    def usage(scope: str, columns: list[str], cap: int) -> DataFrame:
        return (
            log.groupBy(*columns)
            .agg(F.count(F.lit(1)).alias("n_calls"))
            .select(
                F.lit(scope).alias("scope"),
                F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("scope_key"),
                "n_calls",
                (F.col("n_calls") > cap).alias("is_over"),
            )
        )

    return (
        usage("thread", ["thread_id"], thread_cap)
        .unionByName(usage("tenant_day", ["tenant_id", "day"], day_cap))
        .unionByName(usage("day", ["day"], day_cap))
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Most recent run per thread: runs(thread_id, seq, error_code, response)."""
    return (
        runs.groupBy("thread_id")
        .agg(F.max(F.struct("seq", "error_code", "response")).alias("_run"))
        .select("thread_id", "_run.*")
    )


def thread_state(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """State of each asked thread: its last error, else its response, else incomplete / not found."""
    return asked.join(latest_runs(runs), "thread_id", "left").select(
        "thread_id",
        F.when(F.col("seq").isNull(), F.lit("THREAD_NOT_FOUND"))
        .when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("response").isNotNull(), F.lit("OK"))
        .otherwise(F.lit("THREAD_INCOMPLETE"))
        .alias("state"),
        F.when(F.col("error_code").isNull(), F.col("response")).alias("response"),
    )


def with_expiry(manifest: DataFrame) -> DataFrame:
    """Manifest (…, fetched_at, is_finalized) with ``expires_at``: long when final, else short."""
    seconds = F.when(F.col("is_finalized"), F.lit(FINALIZED_TTL_SECONDS)).otherwise(
        F.lit(PROVISIONAL_TTL_SECONDS)
    )
    return manifest.withColumn(
        "expires_at", F.col("fetched_at") + F.make_dt_interval(secs=seconds)
    )


def refresh_due(expected: DataFrame, manifest: DataFrame, as_of: str) -> DataFrame:
    """Expected (item, flow, year) loads that are missing or stale at ``as_of``.

    A load is still fresh at the very moment it expires.
    """
    keys = ["item_code", "flow", "year"]
    latest = with_expiry(
        manifest.groupBy(*keys)
        .agg(F.max(F.struct("fetched_at", "is_finalized")).alias("_m"))
        .select(*keys, "_m.*")
    )
    reason = F.when(F.col("expires_at").isNull(), F.lit("missing")).when(
        F.col("expires_at") < F.lit(as_of).cast("timestamp"), F.lit("stale")
    )
    return (
        expected.join(latest, keys, "left")
        .withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .select(*keys, "reason", "expires_at")
    )


def result_reuse(requests: DataFrame, results: DataFrame, version: str) -> DataFrame:
    """Requests with ``is_hit`` and the stored result, for results fresh at request time.

    Requests: hs_code, year_start, year_end, fingerprint, requested_at.
    Results: the same key, version, written_at, result.  A request sees the newest result of its key
    and version that was written no later than itself; it is a hit while that one is fresh.

    A result lives for a day, so only results of the request's day and of the day before count.  Each
    day of a key is ordered on its own, and its last result is handed to the next day: a hot key is
    split by days.
    """
    key = ["hs_code", "year_start", "year_end", "fingerprint"]
    stored = F.struct("written_at", "result")
    own = results.filter(F.col("version") == version).select(
        *key, F.to_date("written_at").alias("_day"), F.col("written_at").alias("_at"), stored.alias("_stored")
    )
    newest = own.groupBy(*key, "_day").agg(F.max("_stored").alias("_before"))
    asked = requests.select(
        *key, F.to_date("requested_at").alias("_day"), F.col("requested_at").alias("_at"), F.struct("*").alias("_row")
    )
    events = own.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(
        asked.withColumn("_stored", F.lit(None).cast(own.schema["_stored"].dataType))
    )
    so_far = (
        Window.partitionBy(*key, "_day")
        .orderBy("_at", F.col("_row").isNotNull(), "_stored")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = events.withColumn("_seen", F.last("_stored", ignorenulls=True).over(so_far)).filter(
        "_row IS NOT NULL"
    )
    day_before = newest.withColumn("_day", F.date_add("_day", 1))
    found = seen.join(day_before, [*key, "_day"], "left").withColumn(
        "_seen", F.coalesce("_seen", "_before")
    )
    fresh = F.col("_seen.written_at") + F.make_dt_interval(secs=F.lit(RESULT_TTL_SECONDS)) >= F.col("_at")
    is_hit = F.coalesce(fresh, F.lit(False))
    return found.select(
        "_row.*", is_hit.alias("is_hit"), F.when(is_hit, F.col("_seen.result")).alias("result")
    )


def retain(rows: DataFrame, ts: str, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last ``days`` days; a plain comparison, so it reaches the scan."""
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return rows.filter(F.col(ts) >= start)

"""Request log queries: token bucket, quotas, usage and thread state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import quotas as Q
from ..operators.buckets import token_bucket as bucket_flags
from ..sources import standin as S
from .base import query, with_ctes

# Three calls, refilled over six hours: one every two hours.
REQUESTS = 3
WINDOW_US = 6 * 3600 * 1_000_000

THREAD_LIMIT, TENANT_LIMIT, GLOBAL_LIMIT = 3, 40, 180

LOG = """log AS (
  SELECT user_id AS key, event_id AS call_id, epoch_us(ts) AS ts_us, CAST(ts AS DATE) AS day,
    CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS thread_id,
    't' || (user_id % 5) AS tenant_id FROM events)"""


@query(
    with_ctes(
        LOG,
        "ordered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, call_id) AS n FROM log)",
        f"""walk(key, call_id, ts_us, n, found) AS ( -- RECURSE
          SELECT key, call_id, ts_us, n, {REQUESTS * WINDOW_US}::BIGINT FROM ordered WHERE n = 1
          UNION ALL
          SELECT o.key, o.call_id, o.ts_us, o.n, least({REQUESTS * WINDOW_US}::BIGINT,
            CASE WHEN w.found >= {WINDOW_US} THEN w.found - {WINDOW_US} ELSE w.found END
            + (o.ts_us - w.ts_us) * {REQUESTS})
          FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)""",
        f"""SELECT key, call_id, found >= {WINDOW_US} AS allowed,
          CASE WHEN found >= {WINDOW_US} THEN found - {WINDOW_US} ELSE found END AS tokens FROM walk""",
    )
)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return bucket_flags(S.request_log(spark, d), REQUESTS, WINDOW_US).drop("ts_us")


@query(
    with_ctes(
        LOG,
        """ordered AS (SELECT * REPLACE (CASE WHEN key % 3 = 0 THEN -1 ELSE key END AS key),
            row_number() OVER (PARTITION BY CASE WHEN key % 3 = 0 THEN -1 ELSE key END
              ORDER BY ts_us, call_id) AS n FROM log)""",
        f"""walk(key, call_id, ts_us, n, found) AS ( -- RECURSE
          SELECT key, call_id, ts_us, n, {REQUESTS * WINDOW_US}::BIGINT FROM ordered WHERE n = 1
          UNION ALL
          SELECT o.key, o.call_id, o.ts_us, o.n, least({REQUESTS * WINDOW_US}::BIGINT,
            CASE WHEN w.found >= {WINDOW_US} THEN w.found - {WINDOW_US} ELSE w.found END
            + (o.ts_us - w.ts_us) * {REQUESTS})
          FROM walk w JOIN ordered o ON o.key = w.key AND o.n = w.n + 1)""",
        f"""SELECT key, call_id, found >= {WINDOW_US} AS allowed,
          CASE WHEN found >= {WINDOW_US} THEN found - {WINDOW_US} ELSE found END AS tokens FROM walk""",
    )
)
def token_bucket_hot(spark: SparkSession, d: str) -> DataFrame:
    """A third of all keys as one: its calls span many slices."""
    log = S.request_log(spark, d)
    one = F.when(F.col("key") % 3 == 0, F.lit(-1)).otherwise(F.col("key"))
    hot = log.withColumn("key", one.cast(log.schema["key"].dataType))
    return bucket_flags(hot, REQUESTS, WINDOW_US, slice_rows=200).drop("ts_us")


@query(
    with_ctes(
        LOG,
        """t AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ts_us, call_id) AS a FROM log)""",
        f"""n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, day, a <= {THREAD_LIMIT}
                  ORDER BY ts_us, call_id) AS b FROM t)""",
        f"""g AS (SELECT *, row_number() OVER (PARTITION BY day, a <= {THREAD_LIMIT} AND b <= {TENANT_LIMIT}
                  ORDER BY ts_us, call_id) AS c FROM n)""",
        f"""counted AS (
          SELECT *, a <= {THREAD_LIMIT} AND b <= {TENANT_LIMIT} AND c <= {GLOBAL_LIMIT} AS ok FROM g),
        before AS (
          SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY thread_id
              ORDER BY ts_us, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_thread,
            coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY tenant_id, day
              ORDER BY ts_us, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_tenant
          FROM counted)""",
        f"""SELECT call_id, CASE WHEN ok THEN 'ADMITTED' WHEN in_thread >= {THREAD_LIMIT} THEN 'THREAD_CAP'
          WHEN in_tenant >= {TENANT_LIMIT} THEN 'TENANT_DAY_CAP' ELSE 'DAY_CAP' END AS decision
        FROM before""",
    )
)
def quota_admission(spark: SparkSession, d: str) -> DataFrame:
    log = S.request_log(spark, d)
    L.check_threads(log)
    return L.quota_admission(log, THREAD_LIMIT, TENANT_LIMIT, global_day_cap=GLOBAL_LIMIT).select(
        "call_id", "decision"
    )


# Threads that every tenant uses on every day.
SHARED_THREADS = 40
SHARED_THREAD_LIMIT = 100


@query(
    with_ctes(
        """log AS (
          SELECT event_id AS call_id, CAST(ts AS DATE) AS day, CAST(event_id % 40 AS INTEGER) AS thread,
            CAST(user_id % 5 AS INTEGER) AS tenant, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS n
          FROM events)""",
        # One call after the other: counters of all threads, of the day's tenants and of the day.
        f"""walk(n, day, threads, tenants, total, call_id, decision) AS ( -- RECURSE
          SELECT 0::BIGINT, NULL::DATE, [0 FOR i IN range({SHARED_THREADS})], [0 FOR i IN range(5)], 0,
            NULL::BIGINT, NULL::VARCHAR
          UNION ALL
          SELECT n, day,
            CASE WHEN verdict = 'ADMITTED' THEN [threads[i] + CAST(i = thread + 1 AS INTEGER)
              FOR i IN range(1, {SHARED_THREADS} + 1)] ELSE threads END,
            CASE WHEN verdict = 'ADMITTED' THEN [tenants[i] + CAST(i = tenant + 1 AS INTEGER)
              FOR i IN range(1, 6)] ELSE tenants END,
            total + CAST(verdict = 'ADMITTED' AS INTEGER), call_id, verdict
          FROM (SELECT *, CASE WHEN threads[thread + 1] >= {SHARED_THREAD_LIMIT} THEN 'THREAD_CAP'
              WHEN tenants[tenant + 1] >= {TENANT_LIMIT} THEN 'TENANT_DAY_CAP'
              WHEN total >= {GLOBAL_LIMIT} THEN 'DAY_CAP' ELSE 'ADMITTED' END AS verdict
            FROM (SELECT o.n, o.day, o.thread, o.tenant, o.call_id, w.threads,
                CASE WHEN w.day = o.day THEN w.tenants ELSE [0 FOR i IN range(5)] END AS tenants,
                CASE WHEN w.day = o.day THEN w.total ELSE 0 END AS total
              FROM walk w JOIN log o ON o.n = w.n + 1)))""",
        "SELECT call_id, decision FROM walk WHERE call_id IS NOT NULL",
    )
)
def quota_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Threads that run over all days and tenants."""
    log = S.request_log(spark, d).withColumn(
        "thread_id", F.concat(F.lit("s"), (F.col("call_id") % SHARED_THREADS).cast("string"))
    )
    caps = Q.Caps(SHARED_THREAD_LIMIT, TENANT_LIMIT, GLOBAL_LIMIT)
    return Q.admit(log, caps).select("call_id", "decision")


@query(
    with_ctes(
        LOG,
        f"""SELECT 'thread' AS scope, thread_id AS scope_key, count(*) AS n_calls,
          count(*) > {THREAD_LIMIT} AS is_over FROM log GROUP BY thread_id
        UNION ALL
        SELECT 'tenant_day', tenant_id || '/' || CAST(day AS VARCHAR), count(*),
          count(*) > {TENANT_LIMIT} FROM log GROUP BY tenant_id, day
        UNION ALL
        SELECT 'day', CAST(day AS VARCHAR), count(*), count(*) > {TENANT_LIMIT} FROM log GROUP BY day""",
    )
)
def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    return L.quota_usage(S.request_log(spark, d), THREAD_LIMIT, TENANT_LIMIT)


@query(
    """WITH last AS (
      SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn DESC, CASE WHEN role = 'system' THEN 1 ELSE 0 END DESC,
          CASE WHEN role = 'assistant' THEN sha256(text) END DESC NULLS LAST) AS n
        FROM conversations) WHERE n = 1)
    SELECT thread_id,
      CASE WHEN conv_id IS NULL THEN 'THREAD_NOT_FOUND' WHEN role = 'system' THEN 'RUN_FAILED'
           WHEN role = 'assistant' THEN 'OK' ELSE 'THREAD_INCOMPLETE' END AS state,
      CASE WHEN role = 'assistant' THEN sha256(last.text) END AS response
    FROM (SELECT DISTINCT conv_id AS thread_id FROM conversations
          UNION ALL SELECT DISTINCT -1 - conv_id FROM conversations)
      LEFT JOIN last ON conv_id = thread_id"""
)
def thread_latest(spark: SparkSession, d: str) -> DataFrame:
    """State of every conversation, and of as many unknown ones."""
    threads = S.table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id")).distinct()
    asked = threads.unionByName(threads.select((-1 - F.col("thread_id")).alias("thread_id")))
    return L.thread_state(asked, S.thread_runs(spark, d))

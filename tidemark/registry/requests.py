"""Request queries: validation, windows, fingerprints, shared results, reuse and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..operators import requests as R
from ..operators import trade as T
from ..plans.analysis import requested_windows
from ..session import materialize
from ..sources import standin as S
from .base import query, with_ctes
from .trade import PART_CODE, PART_LINES, TRADE

REQUESTS = f"""requests AS (
  SELECT o_orderkey AS request_id, o_orderdate AS requested_at,
    CASE WHEN o_orderkey % 73 = 1 THEN '{{' || code_text
         ELSE '{{' || code_text || flow_text || year_text || tail_text || '}}' END AS raw
  FROM (
    SELECT o_orderkey, o_orderdate,
      '"hs_code":"' || CASE WHEN o_orderkey % 41 = 7 THEN '12a'
        WHEN o_orderkey % 43 = 5 THEN '999999'
        ELSE {PART_CODE.format(k="(o_orderkey % (SELECT count(*) FROM part))")} END || '"' AS code_text,
      ',"flow":"' || CASE WHEN o_orderkey % 37 = 3 THEN 'sideways'
        WHEN o_orderkey % 5 = 0 THEN 'import' WHEN o_orderkey % 5 = 1 THEN 'export'
        ELSE 'both' END || '"' AS flow_text,
      CASE WHEN o_orderkey % 3 = 0 THEN ''
        WHEN o_orderkey % 3 = 1 THEN ',"year_end":' || CAST(year(o_orderdate) + 1 AS VARCHAR)
        ELSE ',"year_start":' || CAST(CASE WHEN o_orderkey % 47 = 2 THEN 1961
               WHEN o_orderkey % 53 = 4 THEN year(o_orderdate) - 25
               ELSE year(o_orderdate) - 2 END AS VARCHAR)
          || ',"year_end":' || CAST(year(o_orderdate) +
               CASE WHEN o_orderkey % 59 = 6 THEN -9 ELSE 2 END AS VARCHAR) END AS year_text,
      CASE WHEN o_orderkey % 61 = 8 THEN ',"colour":"red"' ELSE '' END ||
      CASE WHEN o_orderkey % 67 = 9 THEN ',"partner_region":"EU"' ELSE '' END ||
      CASE WHEN o_orderkey % 71 = 1 THEN ',"value_or_volume":"volume"' ELSE '' END ||
      ',"tenant_id":"t' || CAST(o_custkey % 5 AS VARCHAR) || '","user_id":"' ||
      CAST(o_custkey AS VARCHAR) || '"' AS tail_text
    FROM orders))"""

PARSED = """parsed AS (
  SELECT request_id, requested_at, raw, json_valid(raw) AS is_json,
    CASE WHEN json_valid(raw) THEN raw->>'hs_code' END AS hs_code,
    coalesce(CASE WHEN json_valid(raw) THEN raw->>'flow' END, 'both') AS flow,
    CASE WHEN json_valid(raw) THEN TRY_CAST(raw->>'year_start' AS INTEGER) END AS year_start,
    CASE WHEN json_valid(raw) THEN TRY_CAST(raw->>'year_end' AS INTEGER) END AS year_end,
    CASE WHEN json_valid(raw) THEN raw->>'partner_region' END AS partner_region,
    coalesce(CASE WHEN json_valid(raw) THEN raw->>'value_or_volume' END, 'value') AS measure,
    CASE WHEN json_valid(raw) THEN list_filter(json_keys(raw), lambda k: k NOT IN
      ('hs_code','flow','year_start','year_end','partner_region','value_or_volume',
       'tenant_id','user_id')) ELSE [] END AS unknown
  FROM requests),
judged AS (
  SELECT *, concat_ws(',',
    CASE WHEN octet_length(encode(raw)) > 65536 THEN 'REQUEST_TOO_LARGE' END,
    CASE WHEN NOT is_json THEN 'MALFORMED_JSON' END,
    CASE WHEN len(unknown) > 0 THEN 'UNKNOWN_FIELD' END,
    CASE WHEN hs_code IS NULL OR NOT regexp_full_match(hs_code, '[0-9]{6}') THEN 'BAD_CODE' END,
    CASE WHEN flow NOT IN ('import','export','both') THEN 'BAD_FLOW' END,
    CASE WHEN measure NOT IN ('value','volume') THEN 'BAD_MEASURE' END,
    CASE WHEN year_start < 1962 OR year_end < 1962 THEN 'YEAR_TOO_EARLY' END,
    CASE WHEN year_start > 2002 OR year_end > 2002 THEN 'YEAR_TOO_LATE' END,
    CASE WHEN year_start > year_end THEN 'YEAR_ORDER' END,
    CASE WHEN year_end - year_start + 1 > 20 THEN 'YEAR_SPAN' END,
    CASE WHEN partner_region IS NOT NULL OR measure = 'volume' THEN 'RESERVED_FILTER' END
    ) AS reasons
  FROM parsed)"""

ADMITTED = f"""resolved AS (
  SELECT *, coalesce(year_end, 2000) AS y_end,
         coalesce(year_start, coalesce(year_end, 2000) - 4) AS y_start FROM judged),
admitted AS (
  SELECT request_id, requested_at, hs_code, flow, partner_region, measure,
    CAST(y_start AS INTEGER) AS year_start, CAST(y_end AS INTEGER) AS year_end,
    CASE WHEN reasons <> '' THEN split_part(reasons, ',', 1)
         WHEN hs_code NOT IN (SELECT {PART_CODE.format(k="p_partkey")} FROM part)
           THEN 'INVALID_HS_CODE'
         WHEN y_start > y_end THEN 'YEAR_ORDER'
         WHEN y_end - y_start + 1 > 20 THEN 'YEAR_SPAN' END AS error_code
  FROM resolved)"""

FINGERPRINT = """sha256(concat_ws('|', CAST(length(flow) AS VARCHAR) || ':' || flow,
  coalesce(CAST(length(partner_region) AS VARCHAR) || ':' || partner_region, 'null'),
  CAST(length(measure) AS VARCHAR) || ':' || measure))"""

REQUEST_CTES = [REQUESTS, PARSED]
ADMIT_CTES = [*REQUEST_CTES, ADMITTED]


def admitted(spark: SparkSession, d: str) -> DataFrame:
    return R.admit_requests(S.requests(spark, d), S.taxonomy(spark, d), S.AS_OF)


@query(
    with_ctes(
        *REQUEST_CTES,
        "SELECT request_id, reasons, hs_code, flow, year_start, year_end FROM judged",
    )
)
def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    return R.validate_requests(S.requests(spark, d), S.AS_OF).select(
        "request_id",
        F.array_join("reasons", ",").alias("reasons"),
        "hs_code",
        "flow",
        "year_start",
        "year_end",
    )


@query(
    """SELECT item_id AS query_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'EMPTY_TEXT'
         WHEN length(text) > 200 THEN 'TEXT_TOO_LONG' END AS error_code FROM benchmark
       UNION ALL
       SELECT p_partkey, CASE WHEN coalesce(length(p_name), 0) = 0 THEN 'EMPTY_TEXT'
         WHEN length(p_name) > 200 THEN 'TEXT_TOO_LONG' END FROM part"""
)
def validate_search(spark: SparkSession, d: str) -> DataFrame:
    names = S.table(spark, d, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query_text")
    )
    texts = S.search_queries(spark, d).unionByName(names)
    return R.validate_search(texts).select("query_id", "error_code")


@query(
    with_ctes(
        *ADMIT_CTES,
        """SELECT request_id, CAST(y_start AS INTEGER) AS year_start,
          CAST(y_end AS INTEGER) AS year_end,
          CASE WHEN y_start > y_end THEN 'YEAR_ORDER'
               WHEN y_end - y_start + 1 > 20 THEN 'YEAR_SPAN' END AS window_reason
        FROM resolved WHERE reasons = ''""",
    )
)
def resolve_windows(spark: SparkSession, d: str) -> DataFrame:
    valid = R.validate_requests(S.requests(spark, d), S.AS_OF).filter("size(reasons) = 0")
    return R.resolve_windows(valid, S.AS_OF).select(
        "request_id", "year_start", "year_end", R.window_reason().alias("window_reason")
    )


@query(with_ctes(*ADMIT_CTES, "SELECT request_id, error_code FROM admitted"))
def first_error(spark: SparkSession, d: str) -> DataFrame:
    return admitted(spark, d).select("request_id", "error_code")


@query(
    with_ctes(
        *ADMIT_CTES,
        f"""SELECT request_id, hs_code, hs_code IN
          (SELECT {PART_CODE.format(k="p_partkey")} FROM part) AS is_known
        FROM parsed WHERE hs_code IS NOT NULL""",
    )
)
def allowlist_codes(spark: SparkSession, d: str) -> DataFrame:
    asked = (
        R.parse_requests(S.requests(spark, d))
        .filter("hs_code IS NOT NULL")
        .select("request_id", "hs_code")
    )
    return R.allowlisted(asked, S.taxonomy(spark, d), "hs_code")


@query(with_ctes(*ADMIT_CTES, f"SELECT request_id, {FINGERPRINT} AS fingerprint FROM parsed"))
def request_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return R.parse_requests(S.requests(spark, d)).select(
        "request_id", R.request_fingerprint().alias("fingerprint")
    )


@query(
    with_ctes(
        *ADMIT_CTES,
        PART_LINES,
        TRADE,
        """keys AS (SELECT DISTINCT hs_code, flow, year_start, year_end FROM admitted
                   WHERE error_code IS NULL)""",
        """totals AS (
          SELECT k.hs_code, k.flow, k.year_start, k.year_end,
                 round(sum(CAST(t.value AS DECIMAL(28,4)))::DOUBLE, 4) AS total
          FROM keys k JOIN trade t ON t.item_code = k.hs_code
            AND t.year BETWEEN k.year_start AND k.year_end
            AND (k.flow = 'both' OR k.flow = t.flow)
          GROUP BY ALL)""",
        f"""SELECT request_id, {FINGERPRINT} AS fingerprint, coalesce(total, 0.0) AS total
        FROM admitted LEFT JOIN totals USING (hs_code, flow, year_start, year_end)
        WHERE error_code IS NULL""",
    )
)
def request_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Total trade of each request's window, computed once per distinct key."""
    key = ["hs_code", "flow", "year_start", "year_end", "fingerprint"]
    valid = materialize(
        admitted(spark, d)
        .filter("error_code IS NULL")
        .withColumn("fingerprint", R.request_fingerprint())
        .select("request_id", *key)
    )
    records = S.trade(spark, d, "part").select(
        F.col("item_code").alias("hs_code"), F.col("flow").alias("_flow"), "year", "value"
    )

    def totals(keys: DataFrame) -> DataFrame:
        in_window = F.col("year").between(F.col("year_start"), F.col("year_end"))
        in_flow = (F.col("flow") == "both") | (F.col("flow") == F.col("_flow"))
        return (
            keys.join(records, "hs_code")
            .filter(in_window & in_flow)
            .groupBy(*key)
            .agg(F.sum(F.col("value").cast("decimal(28,4)")).cast("double").alias("total"))
        )

    return R.coalesce_requests(valid, key, totals).select(
        "request_id", "fingerprint", F.round(F.coalesce("total", F.lit(0.0)), 4).alias("total")
    )


@query(
    with_ctes(
        *ADMIT_CTES,
        f"""keyed AS (SELECT *, {FINGERPRINT} AS fingerprint FROM admitted
                     WHERE error_code IS NULL)""",
        """results AS (
          SELECT hs_code, year_start, year_end, fingerprint,
            requested_at - INTERVAL 12 HOUR AS written_at,
            CASE WHEN flow = 'import' THEN 'v1' ELSE 'v2' END AS version,
            hs_code || ':' || lpad(CAST(request_id AS VARCHAR), 12, '0') AS result FROM keyed)""",
        """stored AS (
          SELECT hs_code, year_start, year_end, fingerprint, written_at, max(result) AS result
          FROM results WHERE version = 'v2' GROUP BY ALL)""",
        """SELECT k.request_id,
          coalesce(s.written_at + INTERVAL 24 HOUR >= k.requested_at, false) AS is_hit,
          CASE WHEN s.written_at + INTERVAL 24 HOUR >= k.requested_at THEN s.result END AS result
        FROM keyed k ASOF LEFT JOIN stored s
          ON k.hs_code = s.hs_code AND k.year_start = s.year_start AND k.year_end = s.year_end
          AND k.fingerprint = s.fingerprint AND k.requested_at >= s.written_at""",
    )
)
def result_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Results stand for earlier answers: one per request, written half a day before it."""
    keyed = materialize(
        admitted(spark, d)
        .filter("error_code IS NULL")
        .withColumn("fingerprint", R.request_fingerprint())
        .withColumn("requested_at", F.col("requested_at").cast("timestamp"))
        .select(
            "request_id", "flow", "hs_code", "year_start", "year_end", "fingerprint", "requested_at"
        )
    )
    padded = F.lpad(F.col("request_id").cast("string"), 12, "0")
    results = keyed.select(
        "hs_code",
        "year_start",
        "year_end",
        "fingerprint",
        (F.col("requested_at") - F.expr("INTERVAL 12 HOURS")).alias("written_at"),
        F.when(F.col("flow") == "import", F.lit("v1")).otherwise(F.lit("v2")).alias("version"),
        F.concat("hs_code", F.lit(":"), padded).alias("result"),
    )
    return L.result_reuse(keyed, results, "v2").select("request_id", "is_hit", "result")


@query(
    with_ctes(
        PART_LINES,
        TRADE,
        """manifest AS (
          SELECT item_code, flow, year, max(last_date) AS fetched_at,
                 bool_and(NOT is_provisional) AS is_finalized FROM trade GROUP BY ALL)""",
        """expected AS (
          SELECT item_code, flow, CAST(unnest(range(1997, 2003)) AS INTEGER) AS year
          FROM (SELECT DISTINCT item_code, flow FROM trade))""",
        """due AS (
          SELECT e.*, fetched_at + CASE WHEN is_finalized THEN INTERVAL 180 DAY
                                        ELSE INTERVAL 6 HOUR END AS expires_at
          FROM expected e LEFT JOIN manifest USING (item_code, flow, year))""",
        """SELECT item_code, flow, year,
          CASE WHEN expires_at IS NULL THEN 'missing' ELSE 'stale' END AS reason
        FROM due WHERE expires_at IS NULL OR expires_at < TIMESTAMP '2001-09-01'""",
    )
)
def refresh_due(spark: SparkSession, d: str) -> DataFrame:
    """Loads count as fetched on the last date they hold."""
    records = materialize(S.trade(spark, d, "part"))
    manifest = records.groupBy("item_code", "flow", "year").agg(
        F.max("last_date").cast("timestamp").alias("fetched_at"),
        F.bool_and(~F.col("is_provisional")).alias("is_finalized"),
    )
    windows = T.fixed_windows(records, 1997, 2002)
    expected = windows.select("item_code", "flow", F.explode(T.year_list()).alias("year"))
    return L.refresh_due(expected, manifest, S.AS_OF).drop("expires_at")


@query(
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_orderdate >= TIMESTAMP '2001-09-01' - INTERVAL 90 DAY"""
)
def retention(spark: SparkSession, d: str) -> DataFrame:
    return L.retain(S.table(spark, d, "orders"), "o_orderdate", S.AS_OF).select(
        "o_orderkey", "o_custkey"
    )


@query(
    with_ctes(
        *ADMIT_CTES,
        """SELECT DISTINCT hs_code AS item_code, f.flow, year_start, year_end
        FROM admitted a JOIN (VALUES ('import'), ('export')) f(flow)
          ON a.flow = 'both' OR a.flow = f.flow
        WHERE error_code IS NULL""",
    )
)
def request_windows(spark: SparkSession, d: str) -> DataFrame:
    return requested_windows(admitted(spark, d))

"""Trade record and trade table queries over the stand-in records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..operators import cellstore as C
from ..operators import trade as T
from ..session import materialize, shared_path
from ..sources import standin as S
from .base import query, with_ctes

START, END = 1993, 2001

LINES = """lines AS (
  SELECT l.*, o.o_orderdate, p.p_brand AS item_code,
         CASE WHEN l_linestatus = 'F' THEN 'import' ELSE 'export' END AS flow,
         CAST(c_nationkey AS VARCHAR) AS partner_code,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         (o_orderstatus = 'P' AND year(o_orderdate) >= 2000 AND l_orderkey % 50 = 0)
           AS is_provisional
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer c ON o_custkey = c_custkey JOIN part p ON l_partkey = p_partkey)"""

PART_CODE = "CASE WHEN {k} < 100000 THEN lpad(CAST({k} AS VARCHAR), 6, '0') ELSE CAST({k} AS VARCHAR) END"

PART_LINES = LINES.replace("p.p_brand AS item_code", PART_CODE.format(k="l_partkey") + " AS item_code")

TRADE = """trade AS (
  SELECT item_code, flow, partner_code, year,
         CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS value,
         bool_or(is_provisional) AS is_provisional, count(*) AS n_lines,
         max(o_orderdate) AS last_date
  FROM lines GROUP BY ALL)"""

KEPT = """kept AS (
  SELECT t.*, n_name AS partner_name FROM trade t
  JOIN nation ON CAST(n_nationkey AS VARCHAR) = partner_code
  WHERE n_nationkey % 12 <> 0 AND n_nationkey <> 8)"""

WINDOWS = f"""windows AS (
  SELECT DISTINCT item_code, flow, {START} AS year_start, {END} AS year_end FROM trade)"""

GRID = """grid AS (
  SELECT w.item_code, w.flow, w.year_start, w.year_end, partner_code,
         min(partner_name) AS partner_name,
         coalesce(list_reduce(list_prepend(0.0::DOUBLE,
           list(value ORDER BY year) FILTER (year BETWEEN year_start AND year_end
                                             AND value IS NOT NULL)), lambda a, b: a + b), 0.0)
           AS cumulative
  FROM kept k JOIN windows w USING (item_code, flow) GROUP BY ALL)"""

RANKED = """ranked AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY item_code, flow, year_start, year_end
             ORDER BY cumulative DESC, partner_name, partner_code) AS INTEGER) AS rank
    FROM grid)
  WHERE rank <= 10)"""

MANIFEST = """manifest AS (
  SELECT item_code, flow, year, sum(n_lines) AS n_lines,
         CASE WHEN sum(n_lines) % 13 = 0
              THEN 'upstream timeout after ' || CAST(sum(n_lines) AS VARCHAR) END AS reason
  FROM trade GROUP BY ALL),
issues AS (SELECT item_code, flow, year, reason FROM manifest WHERE reason IS NOT NULL)"""

STATUS = """status AS (
  SELECT w.item_code, w.flow, w.year_start, w.year_end, w.year,
         coalesce(o.all_reported, false) AS is_finalized,
         o.all_reported IS NULL AND i.year IS NULL AS is_no_data,
         i.year IS NOT NULL AS fetch_failed
  FROM (SELECT *, CAST(unnest(range(year_start, year_end + 1)) AS INTEGER) AS year FROM windows) w
  LEFT JOIN (SELECT item_code, flow, year, bool_and(NOT is_provisional) AS all_reported
             FROM kept GROUP BY ALL) o USING (item_code, flow, year)
  LEFT JOIN (SELECT DISTINCT item_code, flow, year FROM issues) i USING (item_code, flow, year))"""

TABLES = """flags AS (
  SELECT item_code, flow, year_start, year_end,
    coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (is_finalized), '') AS years_finalized,
    coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (is_no_data), '') AS years_no_data,
    coalesce(string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) FILTER (NOT is_finalized), '') AS open_years
  FROM status GROUP BY ALL),
issue_lists AS (
  SELECT w.item_code, w.flow, w.year_start, w.year_end,
         string_agg(CAST(year AS VARCHAR) || ': ' || reason, '; ' ORDER BY year) AS fetch_issues
  FROM issues i JOIN windows w USING (item_code, flow)
  WHERE year BETWEEN year_start AND year_end GROUP BY ALL),
excluded AS (
  SELECT item_code, flow, string_agg(partner_code, ', ' ORDER BY partner_code) AS excluded
  FROM (SELECT DISTINCT item_code, flow, partner_code FROM trade
        WHERE CAST(partner_code AS INTEGER) % 12 = 0 OR partner_code = '8') GROUP BY ALL)"""

RECORDS = [LINES, TRADE, KEPT, WINDOWS]
ISSUES = [*RECORDS, MANIFEST]


def cells(spark: SparkSession, d: str) -> DataFrame:
    return T.partner_cells(S.trade(spark, d), S.partners(spark, d), S.REPORTER)


def shared_records(spark: SparkSession, d: str, by: str = "brand") -> DataFrame:
    """The reduced records, written once for queries that read them in several branches."""
    return materialize(S.trade(spark, d, by))


def brand_tables(spark: SparkSession, d: str, start: int = START, end: int = END) -> DataFrame:
    records = shared_records(spark, d)
    c = T.partner_cells(records, S.partners(spark, d), S.REPORTER)
    return T.trade_table(c, T.fixed_windows(records, start, end), S.trade_issues(records))


def text_list(column: str, separator: str = ", ") -> Column:
    return F.array_join(F.col(column).cast("array<string>"), separator)


@query(
    with_ctes(
        LINES,
        """SELECT item_code, flow, CASE WHEN flow = 'import' THEN 'M' ELSE 'X' END AS flow_code,
          partner_code, year, is_provisional, l_orderkey AS order_key,
          round(coalesce(CASE WHEN l_quantity >= 5 THEN l_extendedprice END,
            CASE WHEN flow = 'import' THEN l_extendedprice * (1 + l_tax)
                 WHEN l_quantity >= 2 THEN l_extendedprice * (1 - l_discount) END), 4) AS value
        FROM lines""",
    )
)
def normalize_records(spark: SparkSession, d: str) -> DataFrame:
    return T.normalize_records(S.trade_raw(spark, d)).select(
        "item_code",
        "flow",
        "flow_code",
        "partner_code",
        "year",
        "is_provisional",
        F.col("seq.l_orderkey").alias("order_key"),
        F.round("value", 4).alias("value"),
    )


@query(
    with_ctes(
        LINES,
        """moved AS (SELECT item_code, flow,
          CAST(CAST(partner_code AS INTEGER) + 3 AS VARCHAR) AS partner_code FROM lines)""",
        """SELECT item_code, flow, partner_code,
          coalesce(n_name, 'Unknown partner (' || partner_code || ')') AS partner_name,
          count(*) AS n_lines
        FROM moved LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = partner_code
        GROUP BY ALL""",
    )
)
def partner_names(spark: SparkSession, d: str) -> DataFrame:
    """Codes moved up by three, so that the last of them are unknown to the dimension."""
    lines = (
        S.trade_raw(spark, d)
        .withColumn("partner_code", (F.col("partner_code").cast("int") + 3).cast("string"))
        .groupBy("item_code", "flow", "partner_code")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )
    known = S.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("partner_code"),
        F.col("n_name").alias("partner_name"),
    )
    return T.with_partner_names(lines, known)


@query(
    with_ctes(
        LINES, TRADE, KEPT, "SELECT item_code, flow, partner_code, year, value FROM kept"
    )
)
def strip_partners(spark: SparkSession, d: str) -> DataFrame:
    return T.strip_partners(S.trade(spark, d), S.partners(spark, d), S.REPORTER).select(
        "item_code", "flow", "partner_code", "year", "value"
    )


LAST_WINS = with_ctes(
    LINES,
    """ordered AS (
      SELECT *, row_number() OVER (PARTITION BY item_code, flow, partner_code, year
          ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
                   l_shipdate DESC, l_quantity DESC, l_extendedprice DESC) AS back
      FROM lines)""",
    """SELECT item_code, flow, partner_code, year, count(*) AS n_records,
      bool_and(NOT is_provisional) AS all_reported,
      round(max(coalesce(CASE WHEN l_quantity >= 5 THEN l_extendedprice END,
        CASE WHEN flow = 'import' THEN l_extendedprice * (1 + l_tax)
             WHEN l_quantity >= 2 THEN l_extendedprice * (1 - l_discount) END))
          FILTER (back = 1), 4) AS value
    FROM ordered GROUP BY ALL""",
)


@query(LAST_WINS)
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    records = T.with_partner_names(
        T.normalize_records(S.trade_raw(spark, d)), S.partners(spark, d)
    )
    return T.last_wins(records).select(
        "item_code",
        "flow",
        "partner_code",
        "year",
        "n_records",
        "all_reported",
        F.round("value", 4).alias("value"),
    )


@query(LAST_WINS)
def cells_after_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A store whose loads were outdated or missing, after one refresh: the cells of all records.

    Before it, loads of years that end in 5 had half their values and years that end in 7 were not there;
    what comes in arrives in two parts, whose cells are merged.
    """
    records = materialize(
        T.with_partner_names(T.normalize_records(S.trade_raw(spark, d)), S.partners(spark, d))
    )
    year = F.col("year") % 10
    old = records.filter(year != 7).withColumn(
        "value", F.when(year == 5, F.col("value") / 2).otherwise(F.col("value"))
    )
    states = C.cell_states(old)
    store = C.CellStore(spark, shared_path(spark), states.schema)
    store.refresh(old.select(*C.LOAD), states)
    fresh = records.filter(year.isin(5, 7))
    even = F.pmod(F.xxhash64("seq"), F.lit(2)) == 0
    parts = [C.cell_states(fresh.filter(even)), C.cell_states(fresh.filter(~even))]
    store.refresh(fresh.select(*C.LOAD), C.merge_states(*parts))
    return C.values(store.read()).select(
        *T.ITEM_FLOW,
        "partner_code",
        "year",
        F.col("n").alias("n_records"),
        (~F.col("is_provisional")).alias("all_reported"),
        F.round("value", 4).alias("value"),
    )


@query(
    with_ctes(
        *RECORDS,
        GRID,
        RANKED,
        """SELECT item_code, flow, rank, partner_code, partner_name,
          round(cumulative, 4) AS cumulative FROM ranked""",
    )
)
def rank_partners(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return T.rank_partners(c, T.fixed_windows(c, START, END)).select(
        "item_code",
        "flow",
        "rank",
        "partner_code",
        "partner_name",
        F.round("cumulative", 4).alias("cumulative"),
    )


@query(
    with_ctes(
        *RECORDS,
        "SELECT item_code, flow, partner_code, "
        + ", ".join(
            f"max(value) FILTER (year = {y}) AS y{y}" for y in range(START, END + 1)
        )
        + " FROM kept GROUP BY ALL",
    )
)
def pivot_years(spark: SparkSession, d: str) -> DataFrame:
    return T.pivot_years(cells(spark, d), START, END)


@query(
    with_ctes(
        *RECORDS,
        """SELECT item_code, flow, partner_code, s.year, value
        FROM (SELECT *, CAST(unnest(range(year_start, year_end + 1)) AS INTEGER) AS year
              FROM (SELECT DISTINCT item_code, flow, partner_code FROM kept)
              JOIN windows USING (item_code, flow)) s
        LEFT JOIN kept USING (item_code, flow, partner_code, year)""",
    )
)
def dense_years(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return T.dense_years(c, T.fixed_windows(c, START, END)).select(
        "item_code", "flow", "partner_code", "year", "value"
    )


@query(
    with_ctes(
        LINES,
        TRADE,
        """SELECT item_code, flow, string_agg(partner_code, ', ' ORDER BY partner_code) AS excluded
        FROM (SELECT DISTINCT item_code, flow, partner_code FROM trade
              WHERE CAST(partner_code AS INTEGER) % 12 = 0 OR partner_code = '8') GROUP BY ALL""",
    )
)
def excluded_codes(spark: SparkSession, d: str) -> DataFrame:
    return T.excluded_codes(cells(spark, d)).select(
        "item_code", "flow", text_list("excluded_partner_codes").alias("excluded")
    )


@query(
    with_ctes(
        *ISSUES,
        STATUS,
        "SELECT item_code, flow, year, is_finalized, is_no_data, fetch_failed FROM status",
    )
)
def year_status(spark: SparkSession, d: str) -> DataFrame:
    records = shared_records(spark, d)
    c = T.partner_cells(records, S.partners(spark, d), S.REPORTER)
    windows = T.fixed_windows(records, START, END)
    return T.year_status(c, windows, S.trade_issues(records)).drop("year_start", "year_end")


@query(
    with_ctes(
        LINES,
        TRADE,
        """SELECT item_code, flow, year, count(*) AS n_records,
          bool_and(NOT is_provisional) AS is_finalized FROM trade GROUP BY ALL""",
    )
)
def partition_finality(spark: SparkSession, d: str) -> DataFrame:
    return T.partition_finality(S.trade(spark, d))


@query(
    with_ctes(
        *ISSUES,
        """missing AS (
          SELECT e.item_code, e.flow, e.year, coalesce(m.reason, 'no load recorded') AS reason
          FROM (SELECT *, CAST(unnest(range(year_start, year_end + 1)) AS INTEGER) AS year
                FROM windows) e
          LEFT JOIN manifest m USING (item_code, flow, year)
          WHERE m.item_code IS NULL OR m.reason IS NOT NULL)""",
        """SELECT item_code, flow,
          string_agg(CAST(year AS VARCHAR) || ': ' || reason, '; ' ORDER BY year) AS fetch_issues,
          string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS fetch_issue_years
        FROM missing GROUP BY ALL""",
    )
)
def fetch_issue_report(spark: SparkSession, d: str) -> DataFrame:
    records = shared_records(spark, d)
    windows = T.fixed_windows(records, START, END)
    expected = windows.select("item_code", "flow", F.explode(T.year_list()).alias("year"))
    issues = T.fetch_issues(expected, S.load_manifest(records))
    return T.issue_lists(issues, windows).select(
        "item_code",
        "flow",
        text_list("fetch_issues", "; ").alias("fetch_issues"),
        text_list("fetch_issue_years").alias("fetch_issue_years"),
    )


@query(
    with_ctes(
        *ISSUES,
        GRID,
        RANKED,
        STATUS,
        TABLES,
        """row_values AS (
          SELECT r.item_code, r.flow, r.rank, r.partner_code, r.partner_name, r.cumulative,
            string_agg(y.year || '=' || coalesce(CAST(CAST(round_even(k.value, 0) AS BIGINT) AS VARCHAR), 'none'),
                       ',' ORDER BY y.year) AS by_year
          FROM ranked r
          JOIN (SELECT *, CAST(unnest(range(year_start, year_end + 1)) AS INTEGER) AS year FROM windows) y
            USING (item_code, flow, year_start, year_end)
          LEFT JOIN kept k ON k.item_code = r.item_code AND k.flow = r.flow
            AND k.partner_code = r.partner_code AND k.year = y.year
          GROUP BY ALL),
        row_texts AS (
          SELECT item_code, flow, string_agg(rank || ':' || partner_code || ':' || partner_name
                   || ':' || CAST(round_even(cumulative, 0) AS BIGINT) || ':' || by_year, '|' ORDER BY rank) AS rows
          FROM row_values GROUP BY ALL)""",
        f"""SELECT f.item_code, f.flow, 'USD' AS unit,
          '{", ".join(str(y) for y in range(START, END + 1))}' AS years,
          years_finalized, years_no_data, coalesce(fetch_issues, '') AS fetch_issues,
          coalesce(excluded, '') AS excluded, coalesce(rows, '') AS rows
        FROM flags f LEFT JOIN row_texts USING (item_code, flow)
        LEFT JOIN issue_lists USING (item_code, flow) LEFT JOIN excluded USING (item_code, flow)""",
    )
)
def trade_table(spark: SparkSession, d: str) -> DataFrame:
    return brand_tables(spark, d).select(
        "item_code",
        "flow",
        "unit",
        text_list("years").alias("years"),
        text_list("years_finalized").alias("years_finalized"),
        text_list("years_no_data").alias("years_no_data"),
        text_list("fetch_issues", "; ").alias("fetch_issues"),
        text_list("excluded_partner_codes").alias("excluded"),
        F.array_join(
            F.transform(
                "rows",
                lambda r: F.concat_ws(
                    ":",
                    r["rank"].cast("string"),
                    r["partner_code"],
                    r["partner_name"],
                    half_even(r["cumulative"]).cast("bigint").cast("string"),
                    F.array_join(
                        F.transform(T.year_list(), lambda y: year_text(y, r["values_by_year"][y])), ","
                    ),
                ),
            ),
            "|",
        ).alias("rows"),
    )


def year_text(year: Column, value: Column) -> Column:
    whole = half_even(value).cast("bigint").cast("string")
    return F.concat(year.cast("string"), F.lit("="), F.coalesce(whole, F.lit("none")))


RENDERED = """cell_texts AS (
  SELECT r.item_code, r.flow, r.year_start, r.year_end, r.rank, r.partner_name, r.cumulative,
         string_agg(CAST(y.year AS VARCHAR) || ': ' ||
           coalesce(format('{:,}', CAST(round_even(k.value, 0) AS BIGINT)), 'no data'), ', '
           ORDER BY y.year) AS by_year
  FROM ranked r
  JOIN (SELECT *, CAST(unnest(range(year_start, year_end + 1)) AS INTEGER) AS year FROM windows) y
    USING (item_code, flow, year_start, year_end)
  LEFT JOIN kept k ON k.item_code = r.item_code AND k.flow = r.flow
    AND k.partner_code = r.partner_code AND k.year = y.year
  GROUP BY ALL),
blocks AS (
  SELECT f.item_code, f.flow, f.year_start, f.year_end,
    CASE WHEN f.flow = 'import' THEN 'IMPORTS' ELSE 'EXPORTS' END || ' (USD, top ' ||
      count(c.rank) || ' partner countries):' ||
      coalesce(string_agg(chr(10) || '  #' || c.rank || ' ' || c.partner_name ||
        ' — ' || (c.year_end - c.year_start + 1) || 'yr cumulative ' || format('{:,}', CAST(round_even(c.cumulative, 0) AS BIGINT)) ||
        ' USD | by year: ' || c.by_year, '' ORDER BY c.rank),
        chr(10) || '  (no partner-country data available)') ||
      coalesce(chr(10) || '  (excluded aggregate/unspecified-partner codes, not shown above: ' ||
        max(e.excluded) || ')', '') ||
      CASE WHEN max(f.open_years) <> '' THEN chr(10) ||
        '  (provisional / not yet finalized years — subject to revision: ' ||
        max(f.open_years) || ')' ELSE '' END AS block
  FROM flags f
  LEFT JOIN cell_texts c USING (item_code, flow, year_start, year_end)
  LEFT JOIN excluded e USING (item_code, flow)
  GROUP BY f.item_code, f.flow, f.year_start, f.year_end)"""


@query(
    with_ctes(
        *ISSUES, GRID, RANKED, STATUS, TABLES, RENDERED, "SELECT item_code, flow, block FROM blocks"
    )
)
def render_block(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("flow") == "import", F.lit("IMPORTS")).otherwise(F.lit("EXPORTS"))
    return brand_tables(spark, d).select(
        "item_code", "flow", T.render_block(label).alias("block")
    )

"""Whole analyses: every request from raw JSON to its checked summary and nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..plans import analysis as A
from ..session import materialize
from ..sources import standin as S
from .base import query, with_ctes
from .requests import ADMIT_CTES
from .taxonomy import TEXT_CTES
from .trade import GRID, KEPT, MANIFEST, PART_LINES, RANKED, STATUS, TABLES, TRADE

PROVENANCE = {"source": "stand-in tables", "reporter_country": "NATION_8", "prompt_version": "v1"}

ANALYSES = r"""listings AS (
  SELECT w.*, count(r.rank) AS n_rows, w.year_end - w.year_start + 1 AS n_years,
    coalesce(string_agg('rank ' || r.rank || ' ' ||
      format('{:,}', CAST(round_even(r.cumulative, 0) AS BIGINT)), '; ' ORDER BY r.rank), '') AS listing,
    coalesce(string_agg(r.rank || ':' || r.partner_code || ':' ||
      CAST(round_even(r.cumulative, 0) AS BIGINT), '|' ORDER BY r.rank), '') AS codes
  FROM windows w LEFT JOIN ranked r USING (item_code, flow, year_start, year_end)
  GROUP BY w.item_code, w.flow, w.year_start, w.year_end),
written AS (
  SELECT a.*,
    'HS code ' || a.hs_code || '.' ||
    CASE WHEN a.flow IN ('import', 'both') THEN ' Imports over ' || i.n_years ||
      ' years in USD: ' || i.listing || '.' ELSE '' END ||
    CASE WHEN a.flow IN ('export', 'both') THEN ' Exports over ' || e.n_years ||
      ' years in USD: ' || e.listing || '.' ELSE '' END AS summary,
    CASE WHEN a.flow IN ('import', 'both') THEN i.n_rows END AS n_imports,
    CASE WHEN a.flow IN ('export', 'both') THEN e.n_rows END AS n_exports,
    CASE WHEN a.flow IN ('import', 'both') THEN f.years_no_data END AS import_gaps,
    CASE WHEN a.flow IN ('import', 'both') THEN i.codes END AS import_rows,
    CASE WHEN a.flow IN ('export', 'both') THEN e.codes END AS export_rows,
    array_to_string(list_filter(regexp_split_to_array(x.taxonomy_text, '\s+'),
      lambda w: w <> '' AND NOT regexp_matches(w, '\d')), ' ') AS description
  FROM admitted a
  LEFT JOIN listings i ON i.item_code = a.hs_code AND i.flow = 'import'
    AND i.year_start = a.year_start AND i.year_end = a.year_end
  LEFT JOIN listings e ON e.item_code = a.hs_code AND e.flow = 'export'
    AND e.year_start = a.year_start AND e.year_end = a.year_end
  LEFT JOIN flags f ON f.item_code = a.hs_code AND f.flow = 'import'
    AND f.year_start = a.year_start AND f.year_end = a.year_end
  LEFT JOIN texts x ON x.code = a.hs_code),
-- What is written about codes that end in 7 has a growth rate; a number before a percent sign is derived.
answers AS (
  SELECT *, coalesce(error_code, CASE WHEN regexp_matches(
      summary || CASE WHEN hs_code LIKE '%7' THEN ' Up 8%.' ELSE '' END, '\d\s*%')
    THEN 'UNGROUNDED_SUMMARY' END) AS final_error
  FROM written)"""

ASKED_WINDOWS = """windows AS (
  SELECT DISTINCT hs_code AS item_code, f.flow, year_start, year_end
  FROM admitted a JOIN (VALUES ('import'), ('export')) f(flow)
    ON a.flow = 'both' OR a.flow = f.flow
  WHERE error_code IS NULL)"""

CTES = [
    *ADMIT_CTES,
    *TEXT_CTES,
    PART_LINES,
    TRADE,
    KEPT,
    ASKED_WINDOWS,
    MANIFEST,
    GRID,
    RANKED,
    STATUS,
    TABLES,
    ANALYSES,
]


def boastful_summary(analyses: DataFrame) -> DataFrame:
    """The default summary, with a made-up growth rate for codes that end in 7."""
    boast = F.when(F.col("item_code").endswith("7"), F.lit(" Up 8%.")).otherwise(F.lit(""))
    return A.default_summary(analyses).withColumn(
        "analytical_summary", F.concat("analytical_summary", boast)
    )


def run_analyses(
    spark: SparkSession,
    d: str,
    describe: A.Writer = A.default_description,
    summarize: A.Writer = boastful_summary,
) -> DataFrame:
    records = materialize(S.trade(spark, d, "part").drop("last_date"))
    return A.trade_analysis(
        S.requests(spark, d),
        S.taxonomy(spark, d),
        S.sections(spark, d),
        records,
        S.partners(spark, d),
        S.trade_issues(records),
        reporter=S.REPORTER,
        as_of=S.AS_OF,
        describe=describe,
        summarize=summarize,
    )


@query(
    with_ctes(
        *CTES,
        """SELECT request_id, final_error AS error_code,
          CASE WHEN error_code IS NULL THEN hs_code END AS hs_code,
          CASE WHEN error_code IS NULL THEN flow END AS flow,
          CASE WHEN error_code IS NULL THEN year_start END AS year_start,
          CASE WHEN error_code IS NULL THEN year_end END AS year_end,
          CASE WHEN final_error IS NULL THEN description END AS item_description,
          CASE WHEN final_error IS NULL THEN summary END AS analytical_summary,
          CASE WHEN final_error IS NULL THEN n_imports END AS n_imports,
          CASE WHEN final_error IS NULL THEN n_exports END AS n_exports,
          CASE WHEN final_error IS NULL THEN import_gaps END AS import_gaps
        FROM answers""",
    )
)
def trade_analysis(spark: SparkSession, d: str) -> DataFrame:
    def n_rows(table: str):
        return F.when(F.col(table).isNotNull(), F.size(F.col(table)["rows"])).cast("bigint")

    return run_analyses(spark, d).select(
        "request_id",
        "error_code",
        "hs_code",
        "flow",
        "year_start",
        "year_end",
        "item_description",
        "analytical_summary",
        n_rows("imports").alias("n_imports"),
        n_rows("exports").alias("n_exports"),
        F.array_join(F.col("imports.years_no_data").cast("array<string>"), ", ").alias(
            "import_gaps"
        ),
    )


@query(
    with_ctes(
        *CTES,
        """SELECT request_id, hs_code, md5(summary) AS summary_digest, n_imports, import_rows, export_rows,
          import_gaps, md5(description) AS description_digest, 'v1' AS prompt_version,
          'USD' AS currency, 'calendar_year' AS period_type, 'NATION_8' AS reporter_country
        FROM answers WHERE final_error IS NULL""",
    )
)
def analysis_document(spark: SparkSession, d: str) -> DataFrame:
    """Fields read back from the written form of each document."""
    documents = A.analysis_document(run_analyses(spark, d), PROVENANCE, S.AS_OF)
    written = documents.withColumn("json", F.to_json("document"))

    def field(path: str):
        return F.get_json_object("json", f"$.{path}")

    def rows_of(table: str):
        rows = F.from_json(
            field(f"{table}.rows"), "array<struct<rank:int,partner_code:string,cumulative:double>>"
        )
        return F.array_join(
            F.transform(
                rows,
                lambda r: F.concat_ws(
                    ":",
                    r["rank"].cast("string"),
                    r["partner_code"],
                    half_even(r["cumulative"]).cast("bigint").cast("string"),
                ),
            ),
            "|",
        )

    return written.select(
        "request_id",
        field("hs_code").alias("hs_code"),
        F.md5(field("analytical_summary")).alias("summary_digest"),
        F.json_array_length(field("imports.rows")).cast("bigint").alias("n_imports"),
        rows_of("imports").alias("import_rows"),
        rows_of("exports").alias("export_rows"),
        F.array_join(F.from_json(field("imports.years_no_data"), "array<string>"), ", ").alias("import_gaps"),
        F.md5(field("item_description")).alias("description_digest"),
        field("provenance.prompt_version").alias("prompt_version"),
        field("provenance.currency").alias("currency"),
        field("provenance.period_type").alias("period_type"),
        field("provenance.reporter_country").alias("reporter_country"),
    )

"""Queries over input files: envelopes, dimension and rule files, raw requests and scores as outsiders send
them.  The files are written from the tables to the shared folder, faults included, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import grounding as G
from ..operators import requests as R
from ..operators import search as H
from ..operators import trade as T
from ..plans import analysis as A
from ..session import shared_path
from ..sources import dimensions as D
from ..sources import envelopes as E
from ..sources import standin as S
from .analysis import CTES as ANALYSIS_CTES
from .analysis import run_analyses
from .base import query, with_ctes
from .taxonomy import TAXONOMY
from .trade import LINES, PART_CODE, TRADE

# --- envelopes -------------------------------------------------------------------------------------


def envelope_files(spark: SparkSession, d: str) -> str:
    """Folder of envelopes, one file for each (item, flow, year), broken by the number n of trade lines:
    n % 11 = 1 cut off, 2 without a count, 3 a record without a required field, 4 one with a wrong type,
    5 one with a period that is no year; n % 13 = 0 reports an error."""
    cell = {
        "reporterCode": F.lit(int(S.REPORTER)),
        "partnerCode": F.col("partner_code").cast("int"),
        "period": F.col("year").cast("string"),
        "cmdCode": F.col("item_code"),
        "flowCode": T.flow_code(F.col("flow")),
        "primaryValue": F.when(F.col("n_lines") % 2 == 0, F.col("value")),
        "cifvalue": F.when(F.col("n_lines") % 3 > 0, F.col("value") / 2),
        "fobvalue": F.col("value") / 4,
        "isReported": ~F.col("is_provisional"),
        "isAggregate": F.lit(False),
        "qty": F.col("n_lines"),
    }

    def record(**changes: Column) -> Column:
        fields = {k: v for k, v in (cell | changes).items() if v is not None}
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    written = {
        "good": record(),
        "lacking": record(isReported=None),
        "mistyped": record(partnerCode=F.lit("many")),
        "timeless": record(period=F.lit("soon")),
    }
    records = S.trade(spark, d).select(
        *T.ITEM_FLOW,
        "year",
        "n_lines",
        F.struct(cell["partnerCode"].alias("order"), *[v.alias(k) for k, v in written.items()]).alias("r"),
    )
    # At most one record for each partner country.
    files = records.groupBy(*T.ITEM_FLOW, "year").agg(
        F.sum("n_lines").alias("n"), F.array_sort(F.collect_list("r")).alias("rs")
    )
    fault = F.col("n") % 11
    first = (
        F.when(fault == 3, F.col("rs")[0]["lacking"])
        .when(fault == 4, F.col("rs")[0]["mistyped"])
        .when(fault == 5, F.col("rs")[0]["timeless"])
        .otherwise(F.col("rs")[0]["good"])
    )
    rest = F.transform(F.slice("rs", 2, F.size("rs")), lambda r: r["good"])
    text = F.concat(
        F.lit('{"elapsedTime":"0.1",'),
        F.when(fault == 2, F.lit("")).otherwise(F.concat(F.lit('"count":'), F.size("rs").cast("string"), F.lit(","))),
        F.lit('"error":"'),
        F.when(F.col("n") % 13 == 0, F.concat(F.lit("timeout after "), F.col("n").cast("string"))).otherwise(F.lit("")),
        F.lit('","data":['),
        F.array_join(F.concat(F.array(first), rest), ","),
        F.when(fault == 1, F.lit("]")).otherwise(F.lit("]}")),
    )
    path = shared_path(spark)
    keys = [*T.ITEM_FLOW, "year"]
    files.select(*keys, text.alias("value")).repartition(*keys).write.partitionBy(*keys).text(path)
    return path


JUDGED = """judged AS (
  SELECT item_code, flow, year, sum(n_lines) AS n,
    CASE WHEN sum(n_lines) % 11 = 1 THEN 'no JSON'
         WHEN sum(n_lines) % 11 IN (2, 3, 4, 5) THEN 'not an envelope'
         WHEN sum(n_lines) % 13 = 0
           THEN 'the source says: timeout after ' || CAST(sum(n_lines) AS VARCHAR) END AS reason
  FROM trade GROUP BY ALL)"""


@query(with_ctes(LINES, TRADE, JUDGED, "SELECT item_code, flow, year, reason FROM judged"))
def envelope_reasons(spark: SparkSession, d: str) -> DataFrame:
    return E.envelope_manifest(E.read_envelopes(spark, envelope_files(spark, d)))


@query(
    with_ctes(
        LINES,
        TRADE,
        JUDGED,
        """SELECT t.item_code, t.flow, t.partner_code, t.year, is_provisional,
          CASE WHEN n_lines % 2 = 0 THEN value
            WHEN t.flow = 'export' THEN value / 4
            WHEN n_lines % 3 > 0 THEN value / 2 END AS value
        FROM trade t JOIN judged j
          ON j.item_code = t.item_code AND j.flow = t.flow AND j.year = t.year AND j.reason IS NULL""",
    )
)
def envelope_records(spark: SparkSession, d: str) -> DataFrame:
    loaded = E.read_envelopes(spark, envelope_files(spark, d))
    return T.normalize_records(E.envelope_records(loaded)).select(
        *T.ITEM_FLOW, "partner_code", "year", "is_provisional", "value"
    )


# --- dimension files -------------------------------------------------------------------------------


def csv_file(rows: DataFrame) -> str:
    """Folder of CSV files with a header, quotes doubled, blanks kept."""
    path = shared_path(rows.sparkSession)
    options = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.csv(path, header=True, quoteAll=True, escape='"', **options)
    return path


@query(
    r"""SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS partner_code,
          n_name || ', called "' || lower(n_name) || '"' || chr(10) || 'since ' || n_regionkey AS partner_name,
          n_nationkey % 12 = 0 AS is_aggregate
        FROM nation"""
)
def partner_file(spark: SparkSession, d: str) -> DataFrame:
    """Codes with leading zeros, names with commas, quotes and line breaks, flags in several spellings."""
    names = F.concat(
        F.col("n_name"),
        F.lit(', called "'),
        F.lower("n_name"),
        F.lit('"\nsince '),
        F.col("n_regionkey").cast("string"),
    )
    flag = F.when(F.col("n_nationkey") % 24 == 0, F.lit(" TRUE ")).when(
        F.col("n_nationkey") % 12 == 0, F.lit("true")
    )
    rows = S.table(spark, d, "nation").select(
        F.coalesce(flag, F.lit("no")).alias("is_aggregate_code"),
        names.alias("partner_desc"),
        F.lit("x").alias("remark"),
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("partner_code"),
    )
    return D.read_partners(spark, csv_file(rows))


@query(with_ctes(TAXONOMY, "SELECT code, description, section, parent, level FROM taxonomy"))
def taxonomy_file(spark: SparkSession, d: str) -> DataFrame:
    """Every code has an outdated row before its own one."""
    versions = F.array(F.concat(F.lit("formerly, "), F.col("description")), F.col("description"))
    rows = S.taxonomy(spark, d).select(
        "level", "parent", "section", F.explode(versions).alias("description"), F.col("code").alias("hscode")
    )
    return D.read_taxonomy(spark, csv_file(rows)).select("code", "description", "section", "parent", "level")


@query(with_ctes(TAXONOMY, "SELECT section, name FROM sections"))
def section_file(spark: SparkSession, d: str) -> DataFrame:
    return D.read_sections(spark, csv_file(S.sections(spark, d).select("name", "section")))


# --- rule files ------------------------------------------------------------------------------------


def rule_file(spark: SparkSession, d: str) -> str:
    """A rule for each part, by its number k: k % 17 = 1 has an unknown code, k % 7 = 3 no section name,
    k % 11 = 5 neither section nor forbidden phrases, and k % 13 = 0 is followed by a blank line."""
    key = F.col("p_partkey")
    first = F.split("p_name", " ")[0]
    rule = F.struct(
        F.when(key % 17 == 1, F.concat(F.lit("X"), S.part_code(key))).otherwise(S.part_code(key)).alias("hs_code"),
        F.when(key % 11 != 5, F.col("p_type")).alias("section"),
        F.when(key % 7 != 3, F.lower("p_type")).alias("section_name"),
        F.array(first).alias("description_must_reference"),
        F.when(key % 11 != 5, F.array(F.lit("best"), F.lit("cheapest"))).alias("description_must_not_contain"),
        F.lit("from the part table").alias("notes"),
    )
    blank = F.when(key % 13 == 0, F.array(F.lit("   "), F.lit(""))).otherwise(F.array().cast("array<string>"))
    lines = S.table(spark, d, "part").select(
        F.explode(F.concat(F.array(F.to_json(rule)), blank)).alias("value")
    )
    path = shared_path(spark)
    lines.write.text(path)
    return path


RULE_ROWS = f"""rules AS (
  SELECT CASE WHEN p_partkey % 17 = 1 THEN 'X' ELSE '' END || {PART_CODE.format(k="p_partkey")} AS code,
    CASE WHEN p_partkey % 11 <> 5 THEN p_type END AS section,
    CASE WHEN p_partkey % 7 <> 3 THEN lower(p_type) END AS section_name,
    split_part(p_name, ' ', 1) AS must,
    CASE WHEN p_partkey % 11 <> 5 THEN 'best,cheapest' END AS must_not,
    concat_ws(',', CASE WHEN p_partkey % 11 = 5 THEN 'section' END,
      CASE WHEN p_partkey % 7 = 3 THEN 'section_name' END,
      CASE WHEN p_partkey % 11 = 5 THEN 'description_must_not_contain' END) AS missing_fields
  FROM part)"""


@query(with_ctes(RULE_ROWS, "SELECT * FROM rules"))
def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.read_rules(spark, rule_file(spark, d)).select(
        "code",
        "section",
        "section_name",
        F.array_join("must", ",").alias("must"),
        F.array_join("must_not", ",").alias("must_not"),
        F.array_join("missing_fields", ",").alias("missing_fields"),
    )


@query(
    with_ctes(
        RULE_ROWS,
        f"""SELECT 'blocking' AS severity, 'missing_field' AS rule, code, missing_fields AS detail
        FROM rules WHERE missing_fields <> ''
        UNION ALL
        SELECT 'blocking', 'unknown_code', code, '' FROM rules
        WHERE code NOT IN (SELECT {PART_CODE.format(k="p_partkey")} FROM part)""",
    )
)
def rule_file_gate(spark: SparkSession, d: str) -> DataFrame:
    """A rule file whose integrity is broken: nothing else of it is judged."""
    leaves = R.leaf_codes(S.taxonomy(spark, d)).select("code", F.col("description").alias("text"))
    none = F.array().cast("array<double>")
    scanned = leaves.select("code", G.scan_numbers(F.col("text"), none, none).alias("scan"))
    return G.rule_gate(D.read_rules(spark, rule_file(spark, d)), leaves, scanned, leaves.select("code"), 1)


# --- raw requests ----------------------------------------------------------------------------------


def odd_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request for each order: wrong JSON types, long texts, years that are none, no objects, too large."""
    key = F.col("o_orderkey")
    long = lambda n: F.repeat(F.lit("u"), n)
    tails = [
        F.lit(',"tenant_id":5}'),
        F.lit(',"partner_region":7}'),
        F.lit(',"year_start":true}'),
        F.concat(F.lit(',"user_id":"'), long(129), F.lit('"}')),
        F.concat(F.lit(',"user_id":"'), long(128), F.lit('"}')),
        F.lit(',"year_end":"soon"}'),
        F.lit(',"partner_region":null}'),
        F.lit("}}"),
        F.lit(""),
        F.lit("}"),
    ]
    tail = tails[-1]
    for i, other in enumerate(tails[:-1]):
        tail = F.when(key % 10 == i, other).otherwise(tail)
    padding = F.when(key % 500 == 9, F.repeat(F.lit(" "), R.MAX_BYTES)).otherwise(F.lit(""))
    body = F.concat(F.lit('{"hs_code":"'), F.lpad((key % 1000000).cast("string"), 6, "0"), F.lit('"'), tail, padding)
    return S.table(spark, d, "orders").select(
        key.alias("request_id"), F.when(key % 10 == 8, F.concat(F.lit("["), body, F.lit("}]"))).otherwise(body).alias("raw")
    )


@query(
    """SELECT o_orderkey AS request_id, CASE
          WHEN o_orderkey % 500 = 9 THEN 'REQUEST_TOO_LARGE'
          WHEN o_orderkey % 10 = 0 THEN 'BAD_TYPE'
          WHEN o_orderkey % 10 = 1 THEN 'BAD_TYPE,RESERVED_FILTER'
          WHEN o_orderkey % 10 = 2 THEN 'BAD_TYPE,BAD_YEAR'
          WHEN o_orderkey % 10 = 3 THEN 'TEXT_TOO_LONG'
          WHEN o_orderkey % 10 = 5 THEN 'BAD_YEAR'
          WHEN o_orderkey % 10 IN (7, 8) THEN 'MALFORMED_JSON,BAD_CODE'
          ELSE '' END AS reasons
        FROM orders"""
)
def validate_odd_requests(spark: SparkSession, d: str) -> DataFrame:
    return R.validate_requests(odd_requests(spark, d), S.AS_OF).select(
        "request_id", F.array_join("reasons", ",").alias("reasons")
    )


# --- scores ----------------------------------------------------------------------------------------


def scored_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, candidates and scores: an order's parts in order of their lines, scored by their discount.

    By the order's number k: k % 7 = 0 has a score above one, k % 11 = 1 none, k % 13 = 2 its first code
    twice, k % 17 = 3 a foreign code, k % 19 = 4 nine more codes, k % 23 = 5 a null score.
    """
    key = F.col("query_id")
    rows = (
        S.table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("query_id"), S.part_code(F.col("l_partkey")).alias("doc_id"))
        .agg(F.min("l_linenumber").alias("position"), F.max("l_discount").alias("discount"))
    )
    queries = rows.select("query_id").distinct()
    extra = queries.filter(key % 19 == 4).select(
        "query_id",
        F.explode(F.sequence(F.lit(1), F.lit(9))).alias("position"),
        F.lit(0.05).alias("discount"),
    ).select("query_id", F.concat(F.lit("E"), F.col("position").cast("string")).alias("doc_id"), (F.col("position") + 100).alias("position"), "discount")
    candidates = rows.unionByName(extra)
    first = F.min("position").over(Window.partitionBy("query_id")) == F.col("position")
    score = (
        F.when(first & (key % 7 == 0), F.lit(1.5))
        .when(first & (key % 23 == 5), F.lit(None).cast("double"))
        .otherwise(F.col("discount") * 8)
    )
    scores = candidates.withColumn("first", first).withColumn("relevance", score).filter(key % 11 != 1)
    twice = scores.filter(F.col("first") & (key % 13 == 2))
    foreign = scores.filter(F.col("first") & (key % 17 == 3)).withColumn("doc_id", F.lit("nowhere"))
    columns = ["query_id", "doc_id", "position", "relevance"]
    every = scores.select(columns).unionByName(twice.select(columns)).unionByName(foreign.select(columns))
    return queries, candidates.select("query_id", "doc_id", "position"), every


@query(
    f"""WITH lines AS (
      SELECT l_orderkey AS query_id, {PART_CODE.format(k="l_partkey")} AS doc_id,
        min(l_linenumber) AS position, max(l_discount) AS discount FROM lineitem GROUP BY ALL),
    broken AS (
      SELECT query_id, query_id % 7 = 0 OR query_id % 11 = 1 OR query_id % 13 = 2 OR query_id % 17 = 3
        OR query_id % 19 = 4 OR query_id % 23 = 5 OR count(*) > 8 AS bad,
        max(discount * 8) AS top, first(doc_id ORDER BY discount DESC, position, doc_id) AS best
      FROM lines GROUP BY query_id)
    SELECT query_id, CASE WHEN bad THEN 'RERANK_INVALID_CANDIDATE' END AS error_code,
      CASE WHEN bad THEN NULL WHEN top >= 0.75 THEN 'auto_selected' WHEN top >= 0.35 THEN 'disambiguate'
           ELSE 'no_candidates_found' END AS outcome,
      CASE WHEN NOT bad AND top >= 0.75 THEN best END AS selected_code
    FROM broken"""
)
def score_rules(spark: SparkSession, d: str) -> DataFrame:
    return H.search_outcome(*scored_orders(spark, d)).drop("ranked")


# --- missing pieces --------------------------------------------------------------------------------


def gappy_description(items: DataFrame) -> DataFrame:
    """The default description, but none for codes that end in 3."""
    whole = A.default_description(items)
    return whole.withColumn(
        "item_description", F.when(~F.col("item_code").endswith("3"), F.col("item_description"))
    )


def gappy_summary(analyses: DataFrame) -> DataFrame:
    """The default summary, but none for codes that end in 5."""
    whole = A.default_summary(analyses)
    return whole.withColumn(
        "analytical_summary", F.when(~F.col("item_code").endswith("5"), F.col("analytical_summary"))
    )


@query(
    with_ctes(
        *ANALYSIS_CTES,
        """SELECT request_id, coalesce(error_code,
            CASE WHEN hs_code LIKE '%3' OR hs_code LIKE '%5' THEN 'INCOMPLETE_STATE' END) AS error_code,
          CASE WHEN error_code IS NULL AND hs_code NOT LIKE '%3' AND hs_code NOT LIKE '%5'
            THEN summary END AS summary
        FROM answers""",
    )
)
def incomplete_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Assembly with a description or a summary missing."""
    return run_analyses(spark, d, gappy_description, gappy_summary).select(
        "request_id", "error_code", F.col("analytical_summary").alias("summary")
    )

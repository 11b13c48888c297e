"""Grounding and rule queries: whole documents, and statements derived from the trade tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import whole
from ..operators import grounding as G
from ..operators import requests as R
from ..operators import taxonomy as X
from ..session import materialize
from ..sources import standin as S
from .base import query, with_ctes
from .taxonomy import TEXT_CTES, TAXONOMY
from .trade import (
    GRID,
    KEPT,
    LINES,
    PART_CODE,
    RANKED,
    TRADE,
    brand_tables,
)

FIRST, LAST = 1997, 2001

FACT_CTES = [
    LINES,
    TRADE,
    KEPT,
    f"""windows AS (
      SELECT DISTINCT item_code, flow, {FIRST} AS year_start, {LAST} AS year_end FROM trade)""",
    GRID,
    RANKED,
    f"""facts AS (
      SELECT DISTINCT item_code, value FROM (
        SELECT item_code, CAST(unnest(range({FIRST}, {LAST} + 1)) AS DOUBLE) AS value FROM windows
        UNION ALL SELECT item_code, round_even(cumulative, 0) FROM ranked
        UNION ALL
        SELECT r.item_code, round_even(k.value, 0) FROM ranked r
        JOIN kept k USING (item_code, flow, partner_code)
        WHERE k.year BETWEEN {FIRST} AND {LAST})),
    structural AS (
      SELECT DISTINCT item_code, CAST(value AS DOUBLE) AS value FROM (
        SELECT item_code, rank AS value FROM ranked
        UNION ALL SELECT item_code, {LAST - FIRST + 1} FROM windows
        UNION ALL SELECT item_code, count(*) FROM ranked GROUP BY item_code, flow))""",
]

# The contexts of a number, as in operators/grounding.
# DuckDB's patterns have no look-behind: a hyphen between digits becomes a space first.
SCAN = r"""cut AS (
  SELECT id, item_code, regexp_extract_all(t, '-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?') AS found,
         regexp_split_to_array(t, '-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?') AS gaps
  FROM (SELECT id, item_code, regexp_replace(regexp_replace(text,
          '(\d)-(\d)', '\1 \2', 'g'), '(\d)-(\d)', '\1 \2', 'g') AS t FROM texts)),
numbered AS (
  SELECT id, item_code, i AS position, CAST(replace(found[i], ',', '') AS DOUBLE) AS value,
         CASE WHEN i > 1 THEN '0' ELSE '' END || gaps[i] AS before,
         gaps[i + 1] || coalesce(substr(found[i + 1], 1, 1), '') AS after
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut)),
scanned AS (
  SELECT id, n.item_code, position, n.value,
    NOT regexp_matches(after, '^\s*(?:%|percent\b|pct\.?|points?\b|pp\b)', 'i') AND
    NOT regexp_matches(before, '\b(?:grew|declined|increased|decreased|rose|fell)\s+by\s*$', 'i')
    AND (f.value IS NOT NULL OR (s.value IS NOT NULL AND (
      regexp_matches(before, '(?:#|\btop\b|\brank(?:s|ed|ing)?\b|\bno\.)\s*$', 'i') OR
      regexp_matches(after, '^[\s-]*(?:years?|partners?|countries)\b', 'i')))) AS grounded
  FROM numbered n
  LEFT JOIN facts f ON f.item_code = n.item_code AND f.value = round_even(n.value, 0)
  LEFT JOIN structural s ON s.item_code = n.item_code AND s.value = round_even(n.value, 0))"""

DOC_TEXTS = """texts AS (
  SELECT doc_id AS id, 'Brand#' || (doc_id % 25 + 1) AS item_code, text FROM documents)"""

STATEMENTS = """texts AS (
  SELECT item_code || '/' || flow || '/' || rank AS id, item_code,
    'Top ' || rank || ' partner: ' || amount || ' USD over 5 years, no. ' || rank || ' with ' ||
    (rank + 3) || '% of ' || less || '; it grew by ' || rank || ', ranked ' || rank || ' among 10 ' ||
    'countries in 1998-1999, then ' || amount || ' points, #' || rank || '-' || (rank + 1) || '. ' ||
    rank AS text
  FROM (SELECT *, format('{:,}', CAST(round_even(cumulative, 0) AS BIGINT)) AS amount,
          format('{:,}', CAST(round_even(cumulative, 0) AS BIGINT) - 7) AS less FROM ranked))"""


def fact_tables(spark: SparkSession, d: str) -> DataFrame:
    return brand_tables(spark, d, FIRST, LAST)


def document_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each document is checked as if it were about one of the brands."""
    return S.corpus(spark, d).select(
        "doc_id",
        F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("item_code"),
        "text",
    )


def scanned_documents(spark: SparkSession, d: str) -> DataFrame:
    return G.ground_texts(document_texts(spark, d), G.table_facts(fact_tables(spark, d)))


def statements(tables: DataFrame) -> DataFrame:
    """One statement per ranked row, mixing true figures, ranks, counts and derived figures."""
    row = tables.select("item_code", "flow", F.explode("rows").alias("r"))
    rank = F.col("r.rank").cast("string")
    amount = whole(F.col("r.cumulative"))
    less = F.format_number(F.bround("r.cumulative", 0) - 7, 0)
    parts: list[Column | str] = [
        "Top ", rank, " partner: ", amount, " USD over 5 years, no. ", rank, " with ",
        (F.col("r.rank") + 3).cast("string"), "% of ", less, "; it grew by ", rank, ", ranked ",
        rank, " among 10 countries in 1998-1999, then ", amount, " points, #", rank, "-",
        (F.col("r.rank") + 1).cast("string"), ". ", rank,
    ]
    return row.select(
        F.concat_ws("/", "item_code", "flow", rank).alias("id"),
        "item_code",
        F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("text"),
    )


@query("""SELECT doc_id, NOT regexp_matches(text, '\\d') AS is_number_free FROM documents""")
def number_free_docs(spark: SparkSession, d: str) -> DataFrame:
    return G.number_free(S.corpus(spark, d)).select("doc_id", "is_number_free")


@query(
    with_ctes(
        *FACT_CTES,
        DOC_TEXTS,
        SCAN,
        "SELECT id AS doc_id, position, value, grounded FROM scanned",
    )
)
def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    return scanned_documents(spark, d).select(
        "doc_id", F.posexplode("scan").alias("position", "n")
    ).select("doc_id", (F.col("position").cast("bigint") + 1).alias("position"), "n.value", "n.grounded")


@query(with_ctes(*FACT_CTES, STATEMENTS, SCAN, "SELECT id, position, value, grounded FROM scanned"))
def statement_grounding(spark: SparkSession, d: str) -> DataFrame:
    tables = materialize(fact_tables(spark, d))
    scanned = G.ground_texts(statements(tables), G.table_facts(tables))
    return scanned.select("id", F.posexplode("scan").alias("position", "n")).select(
        "id", (F.col("position").cast("bigint") + 1).alias("position"), "n.value", "n.grounded"
    )


@query(
    with_ctes(
        *FACT_CTES,
        DOC_TEXTS,
        SCAN,
        """SELECT t.id AS doc_id, count(s.id) AS n_numbers,
          CASE WHEN NOT coalesce(bool_and(s.grounded), true) THEN 'UNGROUNDED_SUMMARY' END
            AS error_code
        FROM texts t LEFT JOIN scanned s USING (id) GROUP BY t.id""",
    )
)
def grounded_docs(spark: SparkSession, d: str) -> DataFrame:
    return G.gate_texts(scanned_documents(spark, d)).select(
        "doc_id", F.size("scan").cast("bigint").alias("n_numbers"), "error_code"
    )


@query(
    with_ctes(
        *FACT_CTES,
        DOC_TEXTS,
        SCAN,
        """SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY position) AS position,
          value FROM scanned WHERE NOT grounded""",
    )
)
def ungrounded_numbers(spark: SparkSession, d: str) -> DataFrame:
    gated = G.gate_texts(scanned_documents(spark, d))
    return gated.select("doc_id", F.posexplode("offending").alias("position", "value")).withColumn(
        "position", F.col("position").cast("bigint") + 1
    )


RULES = f"""rules AS (
  SELECT DISTINCT {PART_CODE.format(k="doc_id * 3")} AS code, source AS section,
    ['HS ', lang, 'goods'] AS must, ['brand#1', 'large', 'red'] AS must_not FROM documents)"""

FINDINGS = """judged AS (
  SELECT r.*, coalesce(taxonomy_text, '') AS t FROM rules r LEFT JOIN texts_of USING (code))"""


def rules(spark: SparkSession, d: str) -> DataFrame:
    """One rule per document, on every third part code; some codes are unknown."""
    return S.table(spark, d, "documents").select(
        S.part_code(F.col("doc_id") * 3).alias("code"),
        F.col("source").alias("section"),
        F.array(F.lit("HS "), F.col("lang"), F.lit("goods")).alias("must"),
        F.array(F.lit("brand#1"), F.lit("large"), F.lit("red")).alias("must_not"),
    )


def part_texts(spark: SparkSession, d: str) -> DataFrame:
    return X.taxonomy_text(S.taxonomy(spark, d), S.sections(spark, d)).select(
        "code", F.col("taxonomy_text").alias("text")
    )


TEXTS_OF = "texts_of AS (SELECT code, taxonomy_text FROM part_texts)"
PART_TEXTS = [c.replace("texts AS (", "part_texts AS (", 1) if "'HS '" in c else c for c in TEXT_CTES]


@query(
    with_ctes(
        *PART_TEXTS,
        TEXTS_OF,
        RULES,
        FINDINGS,
        """SELECT code,
          array_to_string(list_filter(must, lambda p: NOT contains(lower(t), lower(p))), '|') AS missing,
          array_to_string(list_filter(must_not, lambda p: contains(lower(t), lower(p))), '|') AS forbidden
        FROM judged""",
    )
)
def phrase_rules(spark: SparkSession, d: str) -> DataFrame:
    return G.check_phrases(part_texts(spark, d), rules(spark, d)).select(
        "code",
        F.array_join("missing", "|").alias("missing"),
        F.array_join("forbidden", "|").alias("forbidden"),
    )


@query(
    with_ctes(
        TAXONOMY,
        RULES,
        """SELECT count(*) AS n_rules, count(*) FILTER (t.code IS NULL) AS n_unknown,
          count(DISTINCT r.section) AS n_sections,
          count(*) FILTER (t.code IS NULL) = 0 AND count(DISTINCT r.section) >= 10 AS is_sound
        FROM rules r LEFT JOIN (SELECT code FROM taxonomy WHERE level = '6') t USING (code)""",
    )
)
def ruleset_integrity(spark: SparkSession, d: str) -> DataFrame:
    return G.ruleset_integrity(rules(spark, d), R.leaf_codes(S.taxonomy(spark, d)))


GATE = f"""broken AS (
  SELECT 'blocking' AS severity, 'unknown_code' AS rule, code, '' AS detail FROM rules
  WHERE code NOT IN (SELECT {PART_CODE.format(k="p_partkey")} FROM part)
  UNION ALL
  SELECT 'blocking', 'few_sections', '*', CAST(count(DISTINCT section) AS VARCHAR) FROM rules
  HAVING count(DISTINCT section) < 10),
others AS (
  SELECT 'blocking', 'ungrounded_number', code, CAST(n AS VARCHAR) FROM (
    SELECT {PART_CODE.format(k="id * 3")} AS code, count(*) AS n FROM scanned WHERE NOT grounded
    GROUP BY id) WHERE code IN (SELECT code FROM rules)
  UNION ALL
  SELECT 'warn', 'missing_phrase', code, p FROM
    (SELECT code, t, unnest(must) AS p FROM judged) WHERE NOT contains(lower(t), lower(p))
  UNION ALL
  SELECT 'warn', 'forbidden_phrase', code, p FROM
    (SELECT code, t, unnest(must_not) AS p FROM judged) WHERE contains(lower(t), lower(p)))"""

GATED = "SELECT * FROM broken UNION ALL SELECT * FROM others WHERE NOT EXISTS (FROM broken)"


def gated(spark: SparkSession, d: str, ruleset: DataFrame) -> DataFrame:
    scanned = scanned_documents(spark, d).select(
        S.part_code(F.col("doc_id") * 3).alias("code"), "scan"
    )
    leaves = R.leaf_codes(S.taxonomy(spark, d))
    return G.rule_gate(ruleset, part_texts(spark, d), scanned, leaves, 10)


@query(
    with_ctes(
        *PART_TEXTS, TEXTS_OF, RULES, FINDINGS, *FACT_CTES, DOC_TEXTS, SCAN, GATE, GATED
    )
)
def rule_gate(spark: SparkSession, d: str) -> DataFrame:
    """Some rules name unknown codes, so the set is broken and nothing else is judged."""
    return gated(spark, d, rules(spark, d))


@query(
    with_ctes(
        *PART_TEXTS,
        TEXTS_OF,
        RULES.replace("rules AS (", "every_rule AS (", 1),
        f"""rules AS (SELECT * FROM every_rule
            WHERE code IN (SELECT {PART_CODE.format(k="p_partkey")} FROM part))""",
        FINDINGS,
        *FACT_CTES,
        DOC_TEXTS,
        SCAN,
        GATE,
        GATED,
    )
)
def rule_gate_sound(spark: SparkSession, d: str) -> DataFrame:
    """The rules with known codes: the set is sound, so numbers and phrases are judged."""
    leaves = R.leaf_codes(S.taxonomy(spark, d)).select("code").distinct()
    return gated(spark, d, rules(spark, d).join(leaves, "code", "left_semi"))

"""Taxonomy queries over the three-level product tree of the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as N
from ..operators import requests as R
from ..operators import taxonomy as X
from ..sources import standin as S
from .base import query, with_ctes
from .requests import PARSED, REQUESTS
from .trade import PART_CODE

TAXONOMY = f"""taxonomy AS (
  SELECT DISTINCT p_type AS code, lower(p_type) AS description, p_type AS section,
         'TOTAL' AS parent, '2' AS level FROM part
  UNION ALL
  SELECT DISTINCT p_type || '/' || p_brand, lower(p_type) || ' ' || lower(p_brand), p_type,
         p_type, '4' FROM part
  UNION ALL
  SELECT {PART_CODE.format(k="p_partkey")}, p_name, p_type, p_type || '/' || p_brand, '6' FROM part),
sections AS (
  SELECT DISTINCT p_type AS section, lower(p_type) || ' goods of all kinds' AS name
  FROM part WHERE p_type NOT LIKE 'S%')"""

CHAINS = """walk(code, up, step, path) AS ( -- RECURSE
  SELECT code, parent, 0, '' FROM taxonomy
  UNION ALL
  SELECT w.code, t.parent, w.step + 1,
         CASE WHEN w.step = 0 THEN t.description ELSE t.description || ' > ' || w.path END
  FROM walk w JOIN taxonomy t ON t.code = w.up),
chains AS (
  SELECT code, arg_max(path, step) AS path, max(step) AS depth FROM walk GROUP BY code)"""

TEXTS = """texts AS (
  SELECT t.code, t.description, concat_ws(chr(10), 'HS ' || t.code || ': ' || t.description,
    CASE WHEN c.depth > 0 THEN 'Parent headings: ' || c.path END,
    CASE WHEN s.name <> '' THEN 'HS Section ' || t.section || ': ' || upper(s.name[1]) || s.name[2:] END
    ) AS taxonomy_text
  FROM taxonomy t JOIN chains c USING (code) LEFT JOIN sections s USING (section)
  WHERE t.level = '6')"""

TEXT_CTES = [TAXONOMY, CHAINS, TEXTS]


@query(
    with_ctes(TAXONOMY, "SELECT code, description, section, parent FROM taxonomy WHERE level = '6'")
)
def taxonomy_leaves(spark: SparkSession, d: str) -> DataFrame:
    return R.leaf_codes(S.taxonomy(spark, d)).drop("level")


@query(
    with_ctes(
        REQUESTS,
        PARSED,
        TAXONOMY,
        """SELECT k.code, description, section, parent, level
        FROM (SELECT DISTINCT hs_code AS code FROM parsed WHERE hs_code IS NOT NULL) k
        LEFT JOIN taxonomy USING (code)""",
    )
)
def taxonomy_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = (
        R.parse_requests(S.requests(spark, d))
        .filter("hs_code IS NOT NULL")
        .select(F.col("hs_code").alias("code"))
        .distinct()
    )
    return X.lookup(keys, S.taxonomy(spark, d))


@query(with_ctes(TAXONOMY, CHAINS, "SELECT code, path, depth FROM chains"))
def taxonomy_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return X.ancestors(S.taxonomy(spark, d)).select(
        "code",
        F.array_join(F.reverse(F.transform("path", lambda p: p["description"])), " > ").alias(
            "path"
        ),
        F.size("path").alias("depth"),
    )


@query(with_ctes(*TEXT_CTES, "SELECT code, taxonomy_text FROM texts"))
def taxonomy_text(spark: SparkSession, d: str) -> DataFrame:
    return X.taxonomy_text(S.taxonomy(spark, d), S.sections(spark, d)).select(
        "code", "taxonomy_text"
    )


@query(
    with_ctes(
        TAXONOMY,
        """up(leaf, code) AS ( -- RECURSE
          SELECT code, code FROM taxonomy
          UNION ALL SELECT u.leaf, t.parent FROM up u JOIN taxonomy t ON t.code = u.code
            WHERE t.parent IN (SELECT code FROM taxonomy))""",
        f"""money AS (
          SELECT {PART_CODE.format(k="l_partkey")} AS code,
            sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS value
          FROM lineitem GROUP BY 1)""",
        """SELECT u.code, count(*) FILTER (t.level = '6') AS n_leaves,
          CAST(coalesce(sum(m.value), 0) AS DOUBLE) AS value
        FROM up u JOIN taxonomy t ON t.code = u.leaf LEFT JOIN money m ON m.code = u.leaf
        GROUP BY u.code""",
    )
)
def taxonomy_subtree(spark: SparkSession, d: str) -> DataFrame:
    """Leaves and trade value below every node, by interval labels."""
    tree = S.taxonomy(spark, d)
    money = F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)"))
    sold = S.table(spark, d, "lineitem").groupBy(S.part_code(F.col("l_partkey")).alias("code")).agg(
        money.alias("value")
    )
    values = tree.select("code", (F.col("level") == "6").cast("int").cast("long").alias("n_leaves")).join(
        sold, "code", "left"
    )
    sums = N.totals_below(N.label(tree), values, ["n_leaves", "value"])
    return sums.withColumn("value", F.col("value").cast("double"))

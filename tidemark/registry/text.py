"""Text function and lexical index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import impact as I
from ..operators import lexical as B
from ..sources import standin as S
from .base import query, with_ctes

WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"

DOCS = f"""docs AS (
  SELECT doc_id, text, {WORDS.format(t="text")} AS words, len({WORDS.format(t="text")}) AS dl
  FROM documents),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM docs),
postings AS (
  SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, dl, unnest(words) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

BENCH_QUERIES = "queries AS (SELECT item_id AS query_id, text AS query_text FROM benchmark)"

BM25 = f"""query_terms AS (
  SELECT query_id, term, count(*) AS weight
  FROM (SELECT query_id, unnest({WORDS.format(t="query_text")}) AS term FROM queries) GROUP BY ALL),
bm25 AS (
  SELECT query_id, doc_id, sum(weight * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5
           / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM query_terms JOIN terms USING (term) JOIN postings USING (term), corpus
  GROUP BY query_id, doc_id),
lexical AS (
  SELECT query_id, doc_id, score, CAST(row_number() OVER (
           PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank
  FROM bm25 WHERE score > 0)"""


@query(
    with_ctes(
        DOCS,
        """SELECT doc_id, len(words) AS n_tokens, len(list_distinct(words)) AS n_distinct,
          md5(array_to_string(words, ' ')) AS digest FROM docs""",
    )
)
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    words = S.corpus(spark, d).select("doc_id", X.tokens(F.col("text")).alias("words"))
    return words.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("words", " ")).alias("digest"),
    )


@query(
    r"""SELECT doc_id, i AS position, CAST(replace(found[i], ',', '') AS DOUBLE) AS value
    FROM (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(text,
          '(\d)-(\d)', '\1 \2', 'g'), '(\d)-(\d)', '\1 \2', 'g'),
          '-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?') AS found FROM documents))"""
)
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    found = S.corpus(spark, d).select(
        "doc_id", F.posexplode(X.numbers(F.col("text"))).alias("position", "value")
    )
    return found.withColumn("position", F.col("position").cast("bigint") + 1)


@query(
    r"""SELECT doc_id, md5(coalesce(array_to_string(list_filter(
      regexp_split_to_array(text, '\s+'),
      lambda w: w <> '' AND NOT regexp_matches(w, '\d')), ' '), '')) AS digest FROM documents"""
)
def strip_numeric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return S.corpus(spark, d).select(
        "doc_id", F.md5(X.strip_numeric_tokens(F.col("text"))).alias("digest")
    )


@query(
    r"""WITH found AS (
      SELECT 'page' AS source, page_id AS id,
             regexp_extract_all(html, '\b\d{6}\b') AS codes FROM pages
      UNION ALL
      SELECT 'document', doc_id, regexp_extract_all(text, '\b\d{6}\b') FROM documents
      UNION ALL
      SELECT 'part', p_partkey, regexp_extract_all('HS ' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')
        || ': ' || p_name || ' (see ' || lpad(CAST(p_partkey // 2 AS VARCHAR), 6, '0') || ', '
        || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || ')', '\b\d{6}\b') FROM part),
    first_seen AS (
      SELECT source, id, code, min(i) AS i FROM (
        SELECT source, id, unnest(codes) AS code, unnest(range(1, len(codes) + 1)) AS i FROM found)
      GROUP BY ALL)
    SELECT f.source, f.id, coalesce(string_agg(s.code, ',' ORDER BY s.i), '') AS codes
    FROM found f LEFT JOIN first_seen s USING (source, id) GROUP BY ALL"""
)
def extract_codes(spark: SparkSession, d: str) -> DataFrame:
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    half = F.lpad(F.floor(F.col("p_partkey") / 2).cast("string"), 6, "0")
    parts = S.table(spark, d, "part").select(
        F.lit("part").alias("source"),
        F.col("p_partkey").alias("id"),
        F.concat(
            F.lit("HS "), key, F.lit(": "), "p_name", F.lit(" (see "), half, F.lit(", "), key, F.lit(")")
        ).alias("text"),
    )
    pages = S.table(spark, d, "pages").select(
        F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    docs = S.corpus(spark, d).select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text"
    )
    return (
        pages.unionByName(docs)
        .unionByName(parts)
        .select("source", "id", F.array_join(X.codes(F.col("text")), ",").alias("codes"))
    )


@query(
    with_ctes(
        DOCS,
        "SELECT term, df, n_docs, round(avgdl, 6) AS avgdl FROM terms, corpus",
    )
)
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    index = B.build_index(S.corpus(spark, d))
    corpus = index.corpus
    return index.terms.select(
        "term",
        "df",
        corpus.select("n_docs").scalar().alias("n_docs"),
        F.round(corpus.select("avgdl").scalar(), 6).alias("avgdl"),
    )


BM25_TOP = with_ctes(
    DOCS,
    BENCH_QUERIES,
    BM25,
    "SELECT query_id, doc_id, rank, round(score, 6) AS score FROM lexical WHERE rank <= 30",
)


@query(BM25_TOP)
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    queries = S.search_queries(spark, d)
    index = B.materialize_index(B.build_index(S.corpus(spark, d), asked=queries))
    return B.bm25_topk(index, queries, 30).withColumn("score", F.round("score", 6))


@query(BM25_TOP)
def bm25_topk_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same result from blocks with largest impacts, without scoring every document."""
    queries = S.search_queries(spark, d)
    index = I.build_impact_index(B.materialize_index(B.build_index(S.corpus(spark, d), asked=queries)))
    return I.impact_topk(index, queries, 30).withColumn("score", F.round("score", 6))

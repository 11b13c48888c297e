"""Vector, fusion and search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import l2_normalize as unit
from ..functions.text import numbered_candidates
from ..operators import embedding as E
from ..operators import lexical as B
from ..operators import pivots as P
from ..operators import search as H
from ..operators import similarity as V
from ..plans.search import hashed_queries
from ..plans.search import product_search as search_plan
from ..session import materialize
from ..sources import standin as S
from .base import query, with_ctes
from .text import BENCH_QUERIES, BM25, DOCS

CENTROIDS = """centroids AS (
  SELECT label AS query_id, pos, avg(CAST(x AS DECIMAL(18,12)))::DOUBLE AS x
  FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos
        FROM embeddings) GROUP BY ALL)"""

BUCKET = "CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64"

HASHED = f"""doc_weights AS (
  SELECT doc_id, {BUCKET} AS bucket, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY ALL),
doc_units AS (
  SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM doc_weights),
query_weights AS (
  SELECT query_id, {BUCKET} AS bucket, sum(weight) AS n FROM query_terms GROUP BY ALL),
query_units AS (
  SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w
  FROM query_weights),
nearest AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY round(similarity, 9) DESC, doc_id) AS rank
  FROM (SELECT q.query_id, d.doc_id, coalesce(sum(q.w * u.w), 0.0) AS similarity
        FROM (SELECT DISTINCT query_id FROM query_units) i CROSS JOIN docs d
        JOIN query_units q ON q.query_id = i.query_id
        LEFT JOIN doc_units u ON u.doc_id = d.doc_id AND u.bucket = q.bucket
        GROUP BY q.query_id, d.doc_id)),
kept AS (
  SELECT s.* FROM nearest s WHERE s.rank <= 30 AND (
    query_id IN (SELECT query_id FROM lexical) OR
    query_id NOT IN (SELECT query_id FROM nearest GROUP BY query_id HAVING max(similarity) < 0.35))),
fused AS (
  SELECT query_id, doc_id, fusion_score, CAST(row_number() OVER (PARTITION BY query_id
           ORDER BY round(fusion_score, 9) DESC, source, rank) AS INTEGER) AS position
  FROM (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS fusion_score,
               min(source) AS source, arg_min(rank, source) AS rank
        FROM (SELECT query_id, doc_id, rank, 0 AS source FROM lexical WHERE rank <= 30
              UNION ALL SELECT query_id, doc_id, rank, 1 FROM kept)
        GROUP BY query_id, doc_id)),
candidates AS (SELECT * FROM fused WHERE position <= 8)"""

PART_QUERIES = """all_queries AS (
  SELECT 'b' || item_id AS query_id, text AS query_text FROM benchmark
  UNION ALL SELECT DISTINCT 'p ' || p_name, p_name FROM part),
rewrites AS (
  SELECT p_name AS variant, text AS term
  FROM (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name)
  JOIN benchmark ON item_id = k)"""

REWRITTEN = r"""marked AS (
  SELECT q.*, NOT EXISTS (
      SELECT 1 FROM (SELECT unnest(regexp_extract_all(lower(q.query_text), '[\p{L}\p{N}_]+')) AS t)
      WHERE t IN (SELECT term FROM terms)) AS is_zero
  FROM all_queries q),
effective AS (
  SELECT query_id, query_text AS raw_text,
    CASE WHEN is_zero AND term IS NOT NULL AND term <> trim(query_text) THEN term
         ELSE query_text END AS query_text,
    coalesce(is_zero AND term <> trim(query_text), false) AS is_rewritten
  FROM marked LEFT JOIN rewrites ON variant = trim(query_text))"""

SCORES = r"""scores AS (
  SELECT c.query_id, c.doc_id, c.position,
    CASE WHEN len(q.asked) > 0 THEN len(list_intersect(q.asked, list_distinct(d.words)))
      / len(q.asked) ELSE 0.0 END AS relevance
  FROM candidates c JOIN docs d USING (doc_id)
  JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(query_text),
          '[\p{L}\p{N}_]+')) AS asked FROM queries) q USING (query_id)),
decided AS (
  SELECT q.query_id, s.top,
    CASE WHEN s.top >= 0.75 THEN 'auto_selected' WHEN s.top >= 0.35 THEN 'disambiguate'
         ELSE 'no_candidates_found' END AS outcome,
    CASE WHEN s.top >= 0.75 THEN s.best END AS selected_code,
    CASE WHEN s.top >= 0.35 THEN s.listing END AS ranked
  FROM queries q LEFT JOIN (
    SELECT query_id, max(relevance) AS top,
      first(doc_id ORDER BY relevance DESC, position) AS best,
      string_agg(doc_id || ':' || CAST(round(relevance * 10000) AS BIGINT), ','
                 ORDER BY relevance DESC, position) AS listing
    FROM scores GROUP BY query_id) s USING (query_id))"""

SEARCH_CTES = [DOCS, BENCH_QUERIES, BM25, HASHED]


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    texts = S.corpus(spark, d).withColumnRenamed("doc_id", "id")
    return E.hashed_embedding(texts).withColumnRenamed("id", "vec_id")


def all_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages, which the corpus holds, and part names, most of which it does not."""
    bench = S.search_queries(spark, d).select(
        F.concat(F.lit("b"), F.col("query_id").cast("string")).alias("query_id"), "query_text"
    )
    names = S.table(spark, d, "part").select(
        F.concat(F.lit("p "), "p_name").alias("query_id"), F.col("p_name").alias("query_text")
    )
    return bench.unionByName(names.distinct())


def rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Rewrite of a part name: the benchmark passage numbered like its first part, if any."""
    first = (
        S.table(spark, d, "part")
        .groupBy(F.col("p_name").alias("variant"))
        .agg(F.min("p_partkey").alias("item_id"))
    )
    return first.join(S.table(spark, d, "benchmark"), "item_id").select(
        "variant", F.col("text").alias("term")
    )


def bench_candidates(spark: SparkSession, d: str) -> DataFrame:
    queries = S.search_queries(spark, d)
    index = B.materialize_index(B.build_index(S.corpus(spark, d), asked=queries))
    return H.hybrid_candidates(queries, hashed_queries(queries), index, doc_vectors(spark, d))


def ranked_text(column: str) -> Column:
    parts = F.transform(
        column,
        lambda c: F.concat_ws(
            ":",
            c["doc_id"].cast("string"),
            F.round(c["relevance"] * 10000).cast("bigint").cast("string"),
        ),
    )
    return F.array_join(parts, ",")


@query(
    """SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_keys,
       min(len(embedding)) AS min_dims, max(len(embedding)) AS max_dims FROM embeddings"""
)
def vector_table_profile(spark: SparkSession, d: str) -> DataFrame:
    found = V.profile(S.vectors(spark, d))
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("min_dims", "max_dims")})


@query(
    """WITH scaled AS (
      SELECT vec_id, pos, CAST(x AS DOUBLE) * label AS x FROM (
        SELECT vec_id, label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos
        FROM embeddings))
    SELECT vec_id, pos, round(CASE WHEN n > 0 THEN x / n ELSE x END, 6) + 0.0 AS x
    FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM scaled)"""
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Vectors stretched by their label (label 0 makes zero vectors), back at unit length."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    return (
        S.vectors(spark, d)
        .withColumn("scaled", scaled)
        .select("vec_id", F.posexplode(unit(F.col("scaled"))).alias("pos", "x"))
        .select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))
    )


@query(
    with_ctes(
        CENTROIDS,
        """sims AS (
          SELECT query_id, vec_id, sum(c.x * CAST(v.x AS DOUBLE)) / max(norm) AS similarity
          FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS norm FROM centroids) c
          JOIN (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos
                FROM embeddings) v USING (pos) GROUP BY ALL)""",
        """SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id
            ORDER BY round(similarity, 9) DESC, vec_id) AS INTEGER) AS rank FROM sims)
        WHERE rank <= 30""",
    )
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors nearest to the centre of each label."""
    return V.vector_topk(S.label_centroids(spark, d), S.vectors(spark, d), 30).withColumn(
        "similarity", F.round("similarity", 6)
    )


ALL_PAIRS = """WITH sims AS (
      SELECT q.vec_id AS query_id, v.vec_id,
        list_inner_product([x::DOUBLE FOR x IN q.embedding], [x::DOUBLE FOR x IN v.embedding])
          / sqrt(list_inner_product([x::DOUBLE FOR x IN q.embedding], [x::DOUBLE FOR x IN q.embedding]))
          AS similarity
      FROM embeddings q CROSS JOIN embeddings v)
    SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY round(similarity, 9) DESC, vec_id) AS INTEGER) AS rank FROM sims)
    WHERE rank <= 10"""


@query(ALL_PAIRS)
def vector_topk_pivots(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a query, by cells around pivots that are skipped where they lie too far away."""
    index = P.build_pivot_index(S.vectors(spark, d))
    queries = S.vectors(spark, d).withColumnRenamed("vec_id", "query_id")
    return P.pivot_topk(queries, index, 10).withColumn("similarity", F.round("similarity", 6))


@query(ALL_PAIRS)
def vector_topk_all(spark: SparkSession, d: str) -> DataFrame:
    """Every vector as a query against all vectors."""
    queries = S.vectors(spark, d).withColumnRenamed("vec_id", "query_id")
    return V.vector_topk(queries, S.vectors(spark, d), 10).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query(
    with_ctes(
        DOCS,
        """SELECT doc_id, CAST(bucket AS BIGINT) AS bucket,
          round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM (SELECT doc_id, """
        + BUCKET
        + """ AS bucket, count(*) AS n
              FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY ALL)""",
    )
)
def embed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Default embedding of every document, in long form without zeros."""
    return (
        doc_vectors(spark, d)
        .select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("bucket", "weight"))
        .filter("weight > 0")
        .select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("weight", 6).alias("weight"))
    )


@query(
    """SELECT d.doc_id, sha256(text) AS content_hash FROM documents d
       LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0"""
)
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents to embed when the labelled ones are stored, those of quality 0 with an old text."""
    texts = S.corpus(spark, d).withColumnRenamed("doc_id", "id")
    old = F.when(F.col("quality") == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    stored = texts.join(
        S.table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id"
    ).select("id", E.content_hash(old).alias("content_hash"))
    return E.pending(texts, stored).select(F.col("id").alias("doc_id"), "content_hash")


@query(
    """WITH sizes AS (SELECT lang AS query_id, doc_id, CAST(row_number() OVER (
          PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents
          QUALIFY rank <= 30),
    labelled AS (SELECT lang AS query_id, doc_id, CAST(row_number() OVER (
          PARTITION BY lang ORDER BY quality DESC, toxic, doc_id) AS INTEGER) AS rank
        FROM documents JOIN labels USING (doc_id) QUALIFY rank <= 30),
    fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS s, min(source) AS source,
          arg_min(rank, source) AS rank
        FROM (SELECT *, 0 AS source FROM sizes UNION ALL SELECT *, 1 FROM labelled)
        GROUP BY ALL)
    SELECT query_id, doc_id, round(s, 9) AS fusion_score, position FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY round(s, 9) DESC, source, rank) AS INTEGER) AS position FROM fused)
    WHERE position <= 8"""
)
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Per language: the top list by length fused with the top list by label."""
    docs = S.table(spark, d, "documents").select(
        F.col("lang").alias("query_id"), "doc_id", "n_chars"
    )
    by_size = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    by_label = Window.partitionBy("query_id").orderBy(F.desc("quality"), "toxic", "doc_id")
    sizes = docs.withColumn("rank", F.row_number().over(by_size)).filter("rank <= 30")
    labelled = docs.join(S.table(spark, d, "labels"), "doc_id").withColumn(
        "rank", F.row_number().over(by_label)
    ).filter("rank <= 30")
    return H.rrf_fuse([sizes, labelled], 8).withColumn(
        "fusion_score", F.round("fusion_score", 9)
    )


@query(
    with_ctes(
        *SEARCH_CTES,
        """SELECT query_id, doc_id, position, round(fusion_score, 9) AS fusion_score,
          length(text) AS description_length FROM candidates JOIN documents USING (doc_id)""",
    )
)
def hybrid_candidates(spark: SparkSession, d: str) -> DataFrame:
    described = H.with_descriptions(bench_candidates(spark, d), S.corpus(spark, d))
    return described.select(
        "query_id",
        "doc_id",
        "position",
        F.round("fusion_score", 9).alias("fusion_score"),
        F.length("description").cast("bigint").alias("description_length"),
    )


@query(
    with_ctes(
        *SEARCH_CTES,
        """returned AS (SELECT query_id, doc_id FROM nearest WHERE rank <= 8)""",
        """SELECT query_id, count(*) FILTER (l.doc_id IS NULL) AS n_ungrounded,
          count(*) FILTER (l.doc_id IS NULL) > 0 AS is_voided
        FROM returned r LEFT JOIN (SELECT query_id, doc_id FROM lexical WHERE rank <= 30) l
          USING (query_id, doc_id) GROUP BY query_id""",
    )
)
def code_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents checked against the lexical candidates of their query."""
    queries = S.search_queries(spark, d)
    index = B.materialize_index(B.build_index(S.corpus(spark, d), asked=queries))
    candidates = materialize(B.bm25_topk(index, queries, 30).select("query_id", "doc_id"))
    returned = materialize(
        V.vector_topk(hashed_queries(queries), doc_vectors(spark, d), 8).select(
            "query_id", F.col("vec_id").alias("doc_id")
        )
    )
    bad = (
        H.ungrounded_codes(returned, candidates)
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kept = H.grounded_scores(returned, candidates).select("query_id").distinct()
    return (
        returned.select("query_id")
        .distinct()
        .join(bad, "query_id", "left")
        .join(kept.withColumn("_kept", F.lit(True)), "query_id", "left")
        .select(
            "query_id",
            F.coalesce("n", F.lit(0)).alias("n_ungrounded"),
            F.col("_kept").isNull().alias("is_voided"),
        )
    )


@query(
    with_ctes(
        DOCS, PART_QUERIES, REWRITTEN, "SELECT query_id, query_text AS effective_text, is_rewritten FROM effective"
    )
)
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    queries = all_queries(spark, d)
    index = B.build_index(S.corpus(spark, d), asked=queries)
    return H.rewrite_queries(queries, index, rewrites(spark, d)).drop("query_text")


@query(
    with_ctes(
        *SEARCH_CTES,
        SCORES,
        "SELECT query_id, outcome, selected_code, ranked FROM decided",
    )
)
def search_outcome(spark: SparkSession, d: str) -> DataFrame:
    queries = S.search_queries(spark, d)
    candidates = materialize(
        H.with_descriptions(bench_candidates(spark, d), S.corpus(spark, d))
    )
    scores = H.overlap_scores(queries, candidates)
    return H.search_outcome(queries, candidates, scores).select(
        "query_id", "outcome", "selected_code", ranked_text("ranked").alias("ranked")
    )


@query(
    with_ctes(
        *SEARCH_CTES,
        """listed AS (
          SELECT query_id, string_agg(chr(10) || position || '. ' || doc_id || ': ' || text, ''
                                      ORDER BY position) AS lines
          FROM candidates JOIN documents USING (doc_id) GROUP BY query_id)""",
        """SELECT query_id, md5('Search text: "' || query_text || '"' || chr(10) || chr(10) ||
          'Candidates:' || coalesce(lines, '')) AS digest
        FROM queries LEFT JOIN listed USING (query_id)""",
    )
)
def render_candidates(spark: SparkSession, d: str) -> DataFrame:
    described = H.with_descriptions(bench_candidates(spark, d), S.corpus(spark, d))
    lists = described.groupBy("query_id").agg(
        F.array_sort(
            F.collect_list(F.struct("position", F.col("doc_id").alias("code"), "description"))
        ).alias("candidates")
    )
    none = F.array().cast("array<struct<position:int,code:bigint,description:string>>")
    rendered = numbered_candidates(F.col("query_text"), F.coalesce("candidates", none))
    return (
        S.search_queries(spark, d)
        .join(lists, "query_id", "left")
        .select("query_id", F.md5(rendered).alias("digest"))
    )


@query(
    with_ctes(
        DOCS,
        PART_QUERIES,
        REWRITTEN,
        """queries AS (SELECT query_id, query_text FROM effective WHERE length(raw_text) <= 200)""",
        BM25,
        HASHED,
        SCORES,
        """SELECT e.query_id, CASE WHEN length(raw_text) > 200 THEN 'TEXT_TOO_LONG' END AS error_code,
          outcome, selected_code, ranked,
          CASE WHEN length(raw_text) <= 200 THEN is_rewritten END AS is_rewritten
        FROM effective e LEFT JOIN decided USING (query_id)""",
    )
)
def product_search(spark: SparkSession, d: str) -> DataFrame:
    queries = all_queries(spark, d)
    index = B.materialize_index(B.build_index(
        S.corpus(spark, d),
        asked=queries.unionByName(
            rewrites(spark, d).select(
                F.col("variant").alias("query_id"), F.col("term").alias("query_text")
            )
        ),
    ))
    return search_plan(
        queries,
        S.corpus(spark, d),
        index,
        doc_vectors(spark, d),
        rewrites(spark, d),
    ).withColumn("ranked", ranked_text("ranked"))

"""Hybrid retrieval: fusion of rankings, candidate sets, rewrites, relevance and outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize
from .lexical import SCORE_DIGITS, LexicalIndex, bm25_topk, query_terms
from .similarity import vector_topk

# Sizes and thresholds of the search.
RRF_K = 60
PER_SOURCE = 30
FUSED = 8
SIMILARITY_FLOOR = 0.35
AUTO_SELECT = 0.75
RELEVANCE_FLOOR = 0.35

#: Score rows that one task groups, on average.  They are short and compress well, so that partitions merged
#: by their size in bytes would hold far too many of them.
SCORES_A_TASK = 1 << 18


def rrf_fuse(rankings: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of rankings (query_id, doc_id, rank), best ``k`` per query.

    Ties go to the document that appears first: in the earlier ranking, then at the better rank.
    """
    tagged = None
    for number, ranking in enumerate(rankings):
        part = ranking.select("query_id", "doc_id", "rank", F.lit(number).alias("source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    fused = tagged.groupBy("query_id", "doc_id").agg(
        F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("fusion_score"),
        F.min(F.struct("source", "rank")).alias("first_seen"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.round("fusion_score", SCORE_DIGITS).desc(), "first_seen"
    )
    return (
        fused.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .drop("first_seen")
    )


def floored_queries(lexical: DataFrame, similar: DataFrame) -> DataFrame:
    """Queries with no lexical hit and no vector at least ``SIMILARITY_FLOOR`` close."""
    best = similar.groupBy("query_id").agg(F.max("similarity").alias("best"))
    return (
        best.join(lexical.select("query_id").distinct(), "query_id", "left_anti")
        .filter(F.col("best") < SIMILARITY_FLOOR)
        .select("query_id")
    )


def with_descriptions(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Add the text of each candidate, '' when it has none.

    Candidates are few.  The documents are first cut down to them by a semi join, so that the texts
    of the whole corpus are never shuffled.
    """
    candidates = materialize(candidates)
    described = documents.join(
        candidates.select("doc_id").distinct(), "doc_id", "left_semi"
    ).select("doc_id", F.col("text").alias("_text"))
    return (
        candidates.join(described, "doc_id", "left")
        .withColumn("description", F.coalesce("_text", F.lit("")))
        .drop("_text")
    )


def hybrid_candidates(
    queries: DataFrame,
    query_vectors: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    per_source: int = PER_SOURCE,
    k: int = FUSED,
) -> DataFrame:
    """(query_id, doc_id, fusion_score, position): lexical and vector top lists, fused.

    ``query_vectors``: query_id, embedding.  ``vectors``: vec_id (= doc_id), embedding.  Both top
    lists are short and used twice, for the floor and for the fusion, so they are written once.  So are
    the vectors, which may be computed from texts: the search counts them before it deals them out.
    """
    query_vectors, vectors = materialize(query_vectors), materialize(vectors)
    lexical = materialize(
        bm25_topk(index, queries, per_source).select("query_id", "doc_id", "rank")
    )
    similar = materialize(
        vector_topk(query_vectors, vectors, per_source).withColumnRenamed("vec_id", "doc_id")
    )
    floored = floored_queries(lexical, similar)
    kept = similar.join(floored, "query_id", "left_anti")
    return rrf_fuse([lexical, kept], k)


def zero_hit_queries(queries: DataFrame, index: LexicalIndex) -> DataFrame:
    """Queries none of whose terms occurs in the corpus."""
    hits = query_terms(queries).join(index.terms, "term", "left_semi").select("query_id").distinct()
    return queries.join(hits, "query_id", "left_anti")


def rewrite_queries(queries: DataFrame, index: LexicalIndex, rewrites: DataFrame) -> DataFrame:
    """Queries with ``effective_text`` and ``is_rewritten``.

    Only zero-hit queries look up ``rewrites`` (variant, term); one whose rewrite differs from its
    trimmed text is searched again with the rewrite, even if that finds nothing.
    """
    trimmed = F.trim("query_text")
    # Of several rewrites of a variant the first in order counts.
    one_each = rewrites.groupBy("variant").agg(F.min("term").alias("_term"))
    changed = (
        zero_hit_queries(queries, index)
        .join(one_each, trimmed == F.col("variant"))
        .filter(F.col("_term") != trimmed)
        .select("query_id", "_term")
    )
    return queries.join(changed, "query_id", "left").select(
        *queries.columns,
        F.coalesce("_term", "query_text").alias("effective_text"),
        F.col("_term").isNotNull().alias("is_rewritten"),
    )


def overlap_scores(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Default relevance: share of the distinct query tokens found in the description.

    ``queries``: query_id, query_text.  ``candidates``: query_id, doc_id, position, description.
    """
    asked = F.array_distinct(tokens(F.col("query_text")))
    found = F.array_intersect("_asked", tokens(F.col("description")))
    return (
        candidates.join(queries.select("query_id", asked.alias("_asked")), "query_id")
        .withColumn(
            "relevance",
            F.when(F.size("_asked") > 0, F.size(found) / F.size("_asked")).otherwise(F.lit(0.0)),
        )
        .select("query_id", "doc_id", "position", "relevance")
    )


Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def invalid_scores(
    scores: DataFrame, code_rule: Column | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """Queries whose score rows break a rule: a score outside [0,1], a bad code, not 1..8 rows, a code
    scored twice.

    A query without any score row is seen only if ``candidates`` are given: one that has candidates
    must have scores.
    """
    bad_row = F.col("relevance").isNull() | ~F.col("relevance").between(0.0, 1.0)
    if code_rule is not None:
        bad_row = bad_row | ~F.coalesce(code_rule, F.lit(False))
    broken = (
        scores.groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("doc_id").alias("n_codes"),
            F.bool_or(bad_row).alias("bad"),
        )
        .filter(F.col("bad") | (F.col("n") > FUSED) | (F.col("n_codes") < F.col("n")))
        .select("query_id")
    )
    if candidates is None:
        return broken
    asked = candidates.select("query_id").distinct()
    return broken.unionByName(asked.join(scores, "query_id", "left_anti"))


def ungrounded_codes(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored codes that are not among the candidates of their query."""
    return scores.join(
        candidates.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"
    )


def grounded_scores(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """Score rows of queries all of whose codes are candidates; one bad code voids its query."""
    voided = ungrounded_codes(scores, candidates).select("query_id").distinct()
    return scores.join(voided, "query_id", "left_anti")


def search_outcome(
    queries: DataFrame,
    candidates: DataFrame,
    scores: DataFrame,
    code_rule: Column | None = None,
) -> DataFrame:
    """One row per query: outcome, selected code, and the ranked candidates.

    Outcomes: auto_selected, disambiguate, no_candidates_found; a query whose scores are invalid or
    name a foreign code gets error_code RERANK_INVALID_CANDIDATE and no outcome.  ``code_rule`` is a
    further condition every scored code must meet, such as a pattern.
    """
    scores = materialize(scores)
    tasks = max(1, -(-scores.count() // SCORES_A_TASK))
    by_code, scores = (scores.repartition(tasks, *keys) for keys in (["query_id", "doc_id"], ["query_id"]))
    bad = (
        ungrounded_codes(by_code, candidates)
        .select("query_id")
        .unionByName(invalid_scores(scores, code_rule, candidates))
        .distinct()
        .withColumn("_bad", F.lit(True))
    )
    # At most eight rows per valid query reach this list; invalid queries drop out before it.
    ranked = (
        scores.join(bad, "query_id", "left_anti")
        .groupBy("query_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("relevance")).alias("o"), "position", "doc_id", "relevance")
                )
            ).alias("_list")
        )
        .select(
            "query_id",
            F.transform("_list", lambda c: F.struct(c["doc_id"], c["relevance"])).alias("ranked"),
        )
    )
    top = F.get("ranked", F.lit(0))
    found = F.coalesce(top["relevance"] >= RELEVANCE_FLOOR, F.lit(False))
    return (
        queries.select("query_id")
        .join(bad, "query_id", "left")
        .join(ranked, "query_id", "left")
        .select(
            "query_id",
            F.when(F.col("_bad"), F.lit("RERANK_INVALID_CANDIDATE")).alias("error_code"),
            F.when(F.col("_bad"), F.lit(None).cast("string"))
            .when(top["relevance"] >= AUTO_SELECT, F.lit("auto_selected"))
            .when(found, F.lit("disambiguate"))
            .otherwise(F.lit("no_candidates_found"))
            .alias("outcome"),
            F.when(top["relevance"] >= AUTO_SELECT, top["doc_id"]).alias("selected_code"),
            F.when(found, F.col("ranked")).alias("ranked"),
        )
    )

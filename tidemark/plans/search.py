"""Product search for a whole table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embedding import DIMS, hashed_embedding
from ..operators.lexical import LexicalIndex
from ..operators.requests import MAX_QUERY_TEXT, split_rejects, validate_search
from ..operators.search import (
    FUSED,
    PER_SOURCE,
    Scorer,
    hybrid_candidates,
    overlap_scores,
    rewrite_queries,
    search_outcome,
    with_descriptions,
)
from ..session import materialize


def hashed_queries(queries: DataFrame, dims: int = DIMS) -> DataFrame:
    """Default query embedder: the same hashed embedding as for documents."""
    texts = queries.select(F.col("query_id").alias("id"), F.col("query_text").alias("text"))
    return hashed_embedding(texts, dims).withColumnRenamed("id", "query_id")


def product_search(
    queries: DataFrame,
    documents: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    rewrites: DataFrame,
    *,
    embed_queries: Callable[[DataFrame], DataFrame] = hashed_queries,
    score: Scorer = overlap_scores,
    max_chars: int = MAX_QUERY_TEXT,
) -> DataFrame:
    """Validate, rewrite zero-hit queries, retrieve, score, decide: one row per query.

    Every query is retrieved once, with the text that counts for it; scoring sees that same text.
    """
    valid, rejected = split_rejects(validate_search(queries, max_chars))
    effective = materialize(
        rewrite_queries(valid.drop("error_code"), index, rewrites).select(
            "query_id", F.col("effective_text").alias("query_text"), "is_rewritten"
        )
    )
    candidates = materialize(
        with_descriptions(
            hybrid_candidates(
                effective, embed_queries(effective), index, vectors, PER_SOURCE, FUSED
            ),
            documents,
        )
    )
    outcome = search_outcome(effective, candidates, score(effective, candidates))
    decided = outcome.join(effective.select("query_id", "is_rewritten"), "query_id")
    refused = rejected.select("query_id", "error_code")
    return decided.unionByName(refused, allowMissingColumns=True)

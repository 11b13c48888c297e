"""BM25 over a document table.

Documents: doc_id, text.  Queries: query_id, query_text.

The index is two DataFrames plus a one-row one; keep it lazy for a single job or write it with
``write_index`` for many.  Scoring is a join on ``term``, so only postings of asked terms move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dealt_texts, explode_tokens, tokens
from ..session import materialize

# BM25 parameters.
K1 = 1.5
B = 0.75

# Scores are compared after rounding, so that the order in which doubles were added up on the
# cluster can never change a ranking.
SCORE_DIGITS = 9

#: Scores of a query's term in a document that one task adds up, on average; its groups stay in memory.
PARTS_A_TASK = 2 << 20


@dataclass(frozen=True)
class LexicalIndex:
    """postings(doc_id, dl, term, tf), terms(term, df), corpus(n_docs, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _postings(documents: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    dealt = dealt_texts(documents.select("doc_id", "text"), "doc_id", "text")
    words = explode_tokens(dealt, "text", "doc_id").withColumnRenamed("n_tokens", "dl")
    if vocabulary is not None:
        words = words.join(vocabulary, "term", "left_semi")
    return words.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def _terms(postings: DataFrame) -> DataFrame:
    # Written over the tf column, so that both uses of the postings share one shuffle.
    return postings.groupBy("term").agg(
        F.sum(F.when(F.col("tf") > 0, F.lit(1)).otherwise(F.lit(0))).alias("df")
    )


def corpus_stats(documents: DataFrame) -> DataFrame:
    """Number of documents and mean length over all of them, empty ones included."""
    return documents.select(F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
    )


def build_index(documents: DataFrame, asked: DataFrame | None = None) -> LexicalIndex:
    """Index of ``documents``; with ``asked`` queries, only postings of their terms are kept.

    Statistics do not change by that restriction: length, count and mean come from whole texts.
    """
    # Written, so that its size is known: a small one is broadcast, and only words that are asked for are counted.
    vocabulary = None if asked is None else materialize(query_terms(asked).select("term").distinct())
    postings = _postings(documents, vocabulary)
    return LexicalIndex(postings, _terms(postings), corpus_stats(documents))


def materialize_index(index: LexicalIndex) -> LexicalIndex:
    """The index written once in the shared folder, for plans that use it in several places.

    Terms are counted in the written postings, so that no text is tokenised again for them.
    """
    postings = materialize(index.postings)
    return LexicalIndex(postings, materialize(_terms(postings)), materialize(index.corpus))


def write_index(index: LexicalIndex, path: str) -> None:
    """Store the index; postings sorted by term so that scans skip row groups by term."""
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions(
        "term", "doc_id"
    ).write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{path}/{p}") for p in ("postings", "terms", "corpus")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight): weight is how often the query repeats the term."""
    return (
        explode_tokens(queries, "query_text", "query_id")
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def bm25_scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with the query."""
    corpus = index.corpus.select(F.struct("n_docs", "avgdl")).scalar()
    n_docs, avgdl = corpus["n_docs"], corpus["avgdl"]
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    # Written, so that its size is known: a small one is broadcast and leaves the postings where they are.
    weighted = materialize(
        query_terms(queries)
        .join(index.terms, "term")
        .select("query_id", "term", "df", (F.col("weight") * idf).alias("wi"))
    )
    tf = F.col("tf")
    part = F.col("wi") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / avgdl))
    # Postings are dealt out by document before the join: each document meets its queries in one
    # place, so the joined rows, one per query and shared term, are summed up without a shuffle.
    # Their number, not the size of the postings, says how many tasks that takes.
    joined = weighted.agg(F.sum("df")).first()[0] or 0
    by_document = index.postings.join(
        weighted.select("term").distinct(), "term", "left_semi"
    ).repartition(max(1, -(-joined // PARTS_A_TASK)), "doc_id")
    return (
        by_document.join(weighted.drop("df"), "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(part).alias("score"))
    )


def bm25_topk(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents per query with score > 0; ties in document order."""
    order = Window.partitionBy("query_id").orderBy(
        F.round("score", SCORE_DIGITS).desc(), "doc_id"
    )
    return (
        bm25_scores(index, queries)
        .filter("score > 0")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )

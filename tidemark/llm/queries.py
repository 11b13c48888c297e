"""The operators as queries over whole tables, and SQL where it can express the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    combination_join,
    fingerprints,
    language,
    line_templates,
    manifest,
    near_duplicates,
    packing,
    periodic,
    repeats,
    secret_scan,
    token_counts,
    topk,
)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


@query
def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(read(spark, sf_dir, "documents"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors)


ORACLE["op6_exact_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, vec_id, score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(read(spark, sf_dir, "documents"))


@query
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return near_duplicates.near_duplicates(docs, size=3, percent=85)


@query
def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(read(spark, sf_dir, "documents"))


ORACLE["op2_line_templates"] = line_templates.SQL


@query
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(read(spark, sf_dir, "documents"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(read(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(read(spark, sf_dir, "documents"))


ORACLE["op12_merkle_manifest"] = manifest.SQL


@query
def op11_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combination_join.linked(read(spark, sf_dir, "documents"))


ORACLE["op11_combination_join"] = combination_join.SQL

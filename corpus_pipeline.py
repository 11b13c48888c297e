"""The corpus pipeline: documents to packed token sequences.

Language identification, line dedup, near-duplicate removal, secret redaction, packing.  Each stage takes
(spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's ``docs``.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, line_templates, near_duplicates, packing, secret_scan
from tidemark.llm.common import prepare, read
from tidemark.session import materialize

#: Below this, neither the family nor the language is more likely than not.  With few languages every winner
#: of a vote reaches it, so that in effect only texts without a letter are rejected.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: null and empty texts, and those without a letter.  Rows
    without an id and repeated rows are judged like any other."""
    prepare(spark)
    return language.keep_identified(docs, LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copied lines and lines of recurring templates go from all documents but the first; so do documents
    left empty by that.  Null and empty texts stay as they are; rows with one id count as one document."""
    prepare(spark)
    return line_templates.drop_recurring(docs, every=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; documents without an id stay.  Of rows with one
    id, only those equal in text go."""
    prepare(spark)
    groups = near_duplicates.near_duplicates(docs, size=5, percent=80)
    kept = groups.where("kept and doc_id is not null").select("doc_id").distinct()
    with_id = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    return with_id.dropDuplicates(["doc_id", "text"]).select(*docs.columns).unionByName(
        docs.where(F.col("doc_id").isNull())
    )


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; null texts stay null, and every row stays."""
    prepare(spark)
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.  A null text is packed like an empty one,
    a null id like any other, and repeated rows once each."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for _, stage in first:
        docs = materialize(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)


#: Learned language models and token ids have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None

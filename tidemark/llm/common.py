"""What the operators of this subpackage share: input columns, Arrow batches, bounded caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

#: Rows of an Arrow batch: texts are long, so far fewer than Spark's default.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches that stay small with long texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; any other column is left out."""
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("text"))


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def per_text(
    df: DataFrame, schema: str, rows: Callable[[list[int | None], list[str]], dict[str, list]]
) -> DataFrame:
    """Apply ``rows(doc_ids, texts) -> columns`` to each Arrow batch of (doc_id, text)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in stream:
            got = rows(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            out = out or arrow_schema(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(got[f.name], f.type) for f in out], schema=out
            )

    return df.mapInArrow(batches, schema)


_TYPES = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat DDL string such as ``doc_id long, tokens array<int>``."""
    pairs = (field.split() for field in ddl.split(","))
    return pa.schema([pa.field(name, _TYPES[kind]) for name, kind in pairs])


def grouped(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows, as lists of columns, by the first column of a stream that is sorted by it."""
    key, rows = None, []
    for batch in stream:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != key:
                yield key, list(zip(*rows, strict=True))
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, list(zip(*rows, strict=True))

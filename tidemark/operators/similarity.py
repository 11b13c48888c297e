"""Exact cosine top-k of query vectors over a vector table.

Queries: query_id, embedding.  Vectors: vec_id, embedding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import l2_normalize
from .lexical import SCORE_DIGITS

# Size of a block of queries or of vectors, in bytes of its matrix.
BLOCK_BYTES = 4 << 20

# Most scores a task holds at a time, while it works through a cell.
SCORES_AT_ONCE = 2 << 20


class VectorSizeError(ValueError):
    """Query and stored vectors differ in size."""


def profile(vectors: DataFrame) -> DataFrame:
    """One row: number of vectors, distinct keys, and smallest and largest size."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.count_distinct("vec_id").alias("n_keys"),
        F.min(F.size("embedding")).alias("min_dims"),
        F.max(F.size("embedding")).alias("max_dims"),
    )


def checked_vectors(vectors: DataFrame, count: int, dims: int) -> DataFrame:
    """The vectors, after comparing one row of aggregates with the metadata; fails on mismatch."""
    found = profile(vectors).first()
    if (found.n_vectors, found.n_keys) != (count, count):
        raise VectorSizeError(
            f"{found.n_vectors} vectors under {found.n_keys} keys, metadata says {count}"
        )
    if count and (found.min_dims, found.max_dims) != (dims, dims):
        raise VectorSizeError(
            f"sizes {found.min_dims} to {found.max_dims}, metadata says {dims}"
        )
    return vectors


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count or (len(sizes) and (sizes != sizes[0]).any()):
        raise VectorSizeError("null vectors, or vectors of several sizes")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(sizes), -1)


def _cell_topk(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The best ``k`` of a block of vectors for each query of a block.

    Order is by rounded similarity, ties by key.
    """
    vectors = vectors.take(pc.sort_indices(vectors["vec_id"]))
    asked, stored = _matrix(queries["embedding"]), _matrix(vectors["embedding"])
    if asked.shape[1] != stored.shape[1]:
        raise VectorSizeError(f"vectors of size {stored.shape[1]} against queries of {asked.shape[1]}")
    n = min(k, len(stored))
    rows, at, exact, rounded = [], [], [], []
    step = max(1, SCORES_AT_ONCE // max(1, len(stored)))
    for first in range(0, len(asked), step):
        sims = asked[first : first + step] @ stored.T
        near = np.round(sims, SCORE_DIGITS)
        floor = np.partition(near, len(stored) - n, axis=1)[:, len(stored) - n]
        row, col = np.nonzero(near >= floor[:, None])
        order = np.lexsort((col, -near[row, col], row))  # keys ascend with the columns
        row, col = row[order], col[order]
        begin = np.searchsorted(row, row)
        best = np.arange(len(row)) - begin < n
        row, col = row[best], col[best]
        rows.append(row + first)
        at.append(col)
        exact.append(sims[row, col])
        rounded.append(near[row, col])
    return pa.table(
        {
            "query_id": queries["query_id"].take(pa.array(np.concatenate(rows))),
            "vec_id": vectors["vec_id"].take(pa.array(np.concatenate(at))),
            "similarity": pa.array(np.concatenate(exact)),
            "rounded": pa.array(np.concatenate(rounded)),
        }
    )


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Best ``k`` vectors per query by cosine similarity, ties by key.

    Vectors are expected at unit length, queries need not be; keys may be of any type that can be
    ordered, null vectors fail.  Both tables are dealt into blocks of about ``block_bytes`` by a hash
    of their keys.  A cell of the grid of blocks is one task's work, a few matrix products; it returns
    its best k for each query, and these are merged.  No block passes through the driver, a row is
    sent once for each block of the other table.
    """
    unit = queries.select(
        "query_id",
        l2_normalize(
            F.coalesce("embedding", F.raise_error(F.lit("VectorSizeError: a query has no vector")))
        ).alias("embedding"),
    )
    schema = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, similarity double, rounded double"
    )
    dims = vectors.select(F.size("embedding")).first()
    rows_each = max(1, block_bytes // (8 * max(1, dims[0] if dims else 1)))
    n_query = max(1, -(-queries.count() // rows_each))
    n_vector = max(1, -(-vectors.count() // rows_each))

    def dealt(rows: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int):
        # Both numbers are long on both sides: int and long hash differently, and a cell's sides would not meet.
        return rows.select(
            F.pmod(F.xxhash64(key), F.lit(n_own).cast("long")).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))).alias(other),
            key,
            "embedding",
        ).groupBy("query_block", "vector_block")

    no_score = pa.array([], pa.float64())

    def cell(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not len(asked) or not len(stored):
            none = pa.table({"query_id": asked["query_id"][:0], "vec_id": stored["vec_id"][:0]})
            return none.append_column("similarity", no_score).append_column("rounded", no_score)
        return _cell_topk(asked, stored, k)

    scored = (
        dealt(unit, "query_id", "query_block", n_query, "vector_block", n_vector)
        .cogroup(
            dealt(vectors, "vec_id", "vector_block", n_vector, "query_block", n_query)
        )
        .applyInArrow(cell, schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rounded"), "vec_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .drop("rounded")
    )

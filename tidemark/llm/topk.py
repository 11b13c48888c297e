"""Exact top-k search by exhaustive term-at-a-time accumulation over integer vectors.

Vectors become integers (floor of 64 times each component, as double).  Queries and candidates are dealt
into blocks by a hash of their id; each pair of blocks is one task's work.  There a candidate block is
kept as postings, for each position the rows with a weight other than zero there; a query's row scatters
each of its weights times the postings into a dense array of scores.  The k best are picked by partition,
with ties to the smaller id, and the blocks' lists are merged by a window that keeps k rows for a query.

No row is left out and no pairs are stored.  Blocks have a bounded number of rows, a row is sent once for
each block of the other side.  Null vectors, vectors with null or non-finite components and null ids take
no part; an empty vector scores 0 with all.  Vectors of different lengths meet at their common positions.
Equal ids are one query (its smallest vector) and are no candidates of each other; otherwise each
repeated row is a candidate of its own.  Scores are 64-bit integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 20
SCALE = 64
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: Postings that cover at least this share of a block are added as a whole row.
DENSE = 0.3


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    vector = F.col(vec_col)
    return table.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(vector).alias("v")
    )


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all candidates but its own."""
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    candidate_blocks = max(1, math.ceil(candidates.count() / CANDIDATE_BLOCK))

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return rows.select(
            F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
            "vec_id",
            "v",
        )

    left = dealt(queries, "qb", query_blocks, "cb", candidate_blocks).groupBy("qb", "cb")
    right = dealt(candidates, "cb", candidate_blocks, "qb", query_blocks).groupBy("qb", "cb")

    def block(q: pa.Table, c: pa.Table) -> pa.Table:
        return best_of_block(q, c, k)

    found = left.cogroup(right).applyInArrow(block, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_of_block(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    ids = candidates["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    postings = postings_of(candidates["v"].take(pa.array(order)))
    n = min(k, len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lowest = np.iinfo(np.int64).min
    terms = queries["v"].combine_chunks()
    weights, offsets = terms.flatten().to_numpy(), np.cumsum([0, *terms.value_lengths().to_pylist()])
    for i, query in enumerate(queries["vec_id"].to_numpy().tolist() if n else []):
        scores = np.zeros(len(ids), np.int64)
        for weight, posting in zip(weights[offsets[i] : offsets[i + 1]].tolist(), postings, strict=False):
            if weight and posting is not None:
                at, values = posting
                scores[at] += weight * values
        own = slice(np.searchsorted(ids, query), np.searchsorted(ids, query, "right"))
        valid = len(ids) - (own.stop - own.start)
        if not (m := min(n, valid)):
            continue
        scores[own] = lowest
        least = np.partition(scores, len(scores) - m)[len(scores) - m]
        above = np.flatnonzero(scores > least)
        level = np.flatnonzero(scores == least)[: m - len(above)]  # ids ascend
        at = np.concatenate([above, level])
        out.append((np.full(len(at), query), ids[at], scores[at]))
    columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def postings_of(vectors: pa.ChunkedArray) -> list:
    """For each position the rows with a weight other than zero, and the weights."""
    vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    out = []
    for position in range(int(lengths.max(initial=0))):
        have = np.flatnonzero(lengths > position)
        values = flat[starts[have] + position]
        rows = have[values != 0]
        if len(rows) >= DENSE * len(lengths):
            row = np.zeros(len(lengths), np.int64)
            row[have] = values
            out.append((slice(None), row))
        else:
            out.append((rows, values[values != 0]) if len(rows) else None)
    return out

"""Exact cosine top-k that skips cells of vectors which lie too far away.

Every vector belongs to the cell of its nearest pivot, and a cell keeps the smallest and the largest angle
between the pivot and its vectors, and their smallest and largest length.  Angles obey the triangle
inequality: if a query lies at angle q from a pivot, no vector of the cell is nearer than the distance from
q to that range, which bounds its similarity.  So

1. each query first searches the most promising cells, as many as hold k vectors, and
2. then only those cells that can still hold a vector as near as its k-th best.

The result is that of comparing all pairs; how many pairs are compared depends on how well the vectors
cluster.  Cells are dealt into parts of bounded size, so a cell with a third of all vectors is no larger a
task than any other.  Cells travel in groups: a query is sent once to each group that has a cell for it, not
once to each cell, and the task skips the group's other cells.  A task answers its queries part by part, and
holds a bounded number of rows found, however many cells its group has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import l2_normalize
from ..session import materialize
from .lexical import SCORE_DIGITS
from .similarity import _cell_topk, _matrix

#: At most so many pivots, whatever the number of vectors: they go to every task (bytes: 8 a dimension).
MOST_PIVOTS = 512
#: Vectors in a part of a cell, and queries compared with it at a time, on average.
PART_ROWS = 4096
#: Vectors in a group of cells, and queries sent to it at a time: a share of the table, so that many tasks
#: work, between PART_ROWS and so many bytes.
GROUP_SHARE = 12
GROUP_BYTES = 64 << 20
#: Rows that a task has found for a part of its queries before they are cut to the best of each query.
FOUND_ROWS = 1 << 19
#: Queries whose angles to all cells a task holds at a time.
CHOSEN_ROWS = 1024
#: Angles are compared with this much room for rounding; it is far above the error of a product.
ROOM = 1e-6


@dataclass(frozen=True)
class PivotIndex:
    """vectors(cell, part, vec_id, embedding); cells(cell, pivot, n, low, high, short, long): range of the
    angles to the pivot and of the lengths."""

    vectors: DataFrame
    cells: DataFrame


@dataclass
class Compared:
    """What a search compared: (query, cell) pairs with a chance, of all pairs there are."""

    near: int = 0
    far: int = 0
    all: int = 0


class Cells:
    """All cells as arrays; at most MOST_PIVOTS."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.cell)
        self.cell = np.array([r.cell for r in rows], np.int64)
        self.pivot = np.array([r.pivot for r in rows], np.float64)
        self.n = np.array([r.n for r in rows], np.int64)
        self.low, self.high, self.short, self.long = (
            np.array([r[c] for r in rows], np.float64) for c in ("low", "high", "short", "long")
        )

    def most(self, queries: np.ndarray) -> np.ndarray:
        """The largest similarity that a vector of each cell can have with each query at unit length."""
        q = np.arccos(np.clip(queries @ self.pivot.T, -1, 1))
        nearest = np.maximum(np.maximum(self.low - q, q - self.high) - ROOM, 0)
        nearest[~queries.any(axis=1)] = 0  # a zero query has no angle
        cos = np.cos(nearest)
        return cos * np.where(cos >= 0, self.long, self.short)

    def first(self, most: np.ndarray, k: int) -> np.ndarray:
        """Whether a cell is among the most promising ones that hold k vectors."""
        order = np.argsort(-most, axis=1, kind="stable")
        n = self.n[order]
        before = np.cumsum(n, axis=1) - n
        out = np.zeros(most.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


def choose_pivots(vectors: DataFrame, n_pivots: int) -> np.ndarray:
    """Vectors from all over the table: those with the smallest hashes of their keys.

    The sample decides how much is skipped, never the result.  It has MOST_PIVOTS rows at most.
    """
    rows = (
        vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n_pivots, MOST_PIVOTS)).select("embedding")
    ).collect()
    return np.array([r.embedding for r in rows], np.float64)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of CHOSEN_ROWS rows at most."""
    for batch in batches:
        for first in range(0, len(batch), CHOSEN_ROWS):
            yield batch.slice(first, CHOSEN_ROWS)


def build_pivot_index(vectors: DataFrame, n_pivots: int | None = None) -> PivotIndex:
    """The index of vectors (vec_id, embedding), written to the shared folder."""
    vectors = materialize(vectors.select("vec_id", "embedding"))
    n = vectors.count()
    pivots = choose_pivots(vectors, n_pivots or max(1, int(n**0.5)))
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300) if len(pivots) else 1
    key_type = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            rows = _matrix(batch.column("embedding"))
            length = np.linalg.norm(rows, axis=1)
            sims = rows @ pivots.T / np.where(length > 0, length, 1)[:, None]
            cell = sims.argmax(axis=1)
            columns = [
                pa.array(cell, pa.int64()),
                batch.column("vec_id"),
                batch.column("embedding"),
                pa.array(np.arccos(np.clip(sims[np.arange(len(cell)), cell], -1, 1))),
                pa.array(length),
            ]
            names = ["cell", "vec_id", "embedding", "angle", "length"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = vectors.schema["embedding"].dataType.simpleString()
    if not n:
        spark = vectors.sparkSession
        empty = spark.createDataFrame([], f"cell long, part long, vec_id {key_type}, embedding {kind}")
        cells = spark.createDataFrame(
            [], "cell long, pivot array<double>, n long, low double, high double, short double, long double"
        )
        return PivotIndex(empty, cells)
    placed = materialize(
        vectors.mapInArrow(run, f"cell long, vec_id {key_type}, embedding {kind}, angle double, length double")
    )
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("angle").alias("low"),
        F.max("angle").alias("high"),
        F.min("length").alias("short"),
        F.max("length").alias("long"),
    )
    known = vectors.sparkSession.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(pivots)], "cell long, pivot array<double>"
    )
    cells = materialize(cells.join(known, "cell"))
    parts = F.ceil(F.col("n") / PART_ROWS)
    dealt = placed.join(cells.select("cell", "n"), "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), "vec_id", "embedding"
    )
    return PivotIndex(materialize(dealt), cells)


def write_pivot_index(index: PivotIndex, path: str) -> None:
    """Store the index; a folder for each cell, so that a search reads only the cells it needs."""
    index.vectors.repartition("cell", "part").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    index.cells.write.mode("overwrite").parquet(f"{path}/cells")


def read_pivot_index(spark: SparkSession, path: str) -> PivotIndex:
    vectors, cells = (spark.read.parquet(f"{path}/{p}") for p in ("vectors", "cells"))
    return PivotIndex(vectors.withColumn("cell", F.col("cell").cast("long")), cells)


Choose = Callable[[np.ndarray, "np.ndarray | None"], np.ndarray]


def _least(batch: pa.RecordBatch) -> np.ndarray | None:
    return batch["s"].to_numpy() if "s" in batch.schema.names else None


def _wanted(choose: Choose, rows: pa.RecordBatch) -> np.ndarray:
    """For each row and cell whether it is chosen; angles to all cells are held for CHOSEN_ROWS rows at a time."""
    parts = list(_parts([rows])) or [rows]
    return np.concatenate([choose(_matrix(part["embedding"]), _least(part)) for part in parts])


def _chosen(rows: DataFrame, choose: Choose, cells: Cells) -> DataFrame:
    """(query_id, cell) of the cells chosen for each of (query_id, embedding[, s])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = np.nonzero(_wanted(choose, batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(q)), pa.array(cells.cell[c])], names=["query_id", "cell"]
            )

    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, cell long")


def _groups(cells: Cells, rows: int) -> np.ndarray:
    """Group of each cell: neighbours in order, until a group has about ``rows`` vectors."""
    return (np.cumsum(cells.n) - cells.n) // rows


def _sent(rows: DataFrame, choose: Choose, group: np.ndarray) -> DataFrame:
    """The rows, once for each group that holds a cell chosen for them."""
    n_groups = int(group.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = _wanted(choose, batch)
            for g in range(n_groups):
                some = batch.take(pa.array(np.nonzero(wanted[:, group == g].any(axis=1))[0]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), g, np.int64)), *some.columns], names=["group", *some.schema.names]
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"group long, {fields}")


def _merged(found: list[pa.Table], k: int) -> pa.Table:
    """The best ``k`` of each query of (query_id, vec_id, similarity, rounded)."""
    rows = pa.concat_tables(found)
    order = [("query_id", "ascending"), ("rounded", "descending"), ("vec_id", "ascending")]
    rows = rows.take(pc.sort_indices(rows, order))
    row = rows["query_id"].to_numpy()
    return rows.filter(pa.array(np.arange(len(row)) - np.searchsorted(row, row) < k))


def _answers(
    batches: Iterator[pa.RecordBatch], keys: list[str], choose: Choose, cells: Cells, k: int
) -> Iterator[pa.RecordBatch]:
    """Best ``k`` for each query of a stream that is sorted by ``keys``, vectors (cell, vec_id, vector) before
    those that ask (query_id, embedding[, s])."""
    key, held, of_cell = None, [], None
    for batch in batches:
        marks = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in (*keys, "asks")]).astype(np.int64)
        ends = [*(np.nonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0))[0] + 1).tolist(), len(batch)]
        for first, end in zip([0, *ends], ends, strict=False):
            *own, asks = marks[:, first].tolist()
            rows = batch.slice(first, end - first)
            if own != key:
                key, held, of_cell = own, [], None
            if not asks:
                held.append(rows.select(["cell", "vec_id", "vector"]))
                continue
            if of_cell is None:
                of_cell, held = _by_cell(held, cells), []
            yield from _answered(rows, of_cell, choose, k)


def _by_cell(held: list[pa.RecordBatch], cells: Cells) -> dict[int, pa.Table]:
    """Vectors (vec_id, embedding) of each cell, by its place among all cells."""
    if not held:
        return {}
    stored = pa.Table.from_batches(held).rename_columns(["cell", "vec_id", "embedding"])
    of_cell = stored["cell"].to_numpy()
    places = np.searchsorted(cells.cell, np.unique(of_cell)).tolist()
    return {at: stored.take(pa.array(np.nonzero(of_cell == cells.cell[at])[0])) for at in places}


def _answered(
    rows: pa.RecordBatch, of_cell: dict[int, pa.Table], choose: Choose, k: int
) -> Iterator[pa.RecordBatch]:
    """Best ``k`` of the cells for each query, by parts of the queries."""
    step = max(1, min(PART_ROWS, FOUND_ROWS // k))
    for first in range(0, len(rows) if of_cell else 0, step):
        asked = rows.slice(first, step)
        wanted = _wanted(choose, asked)
        numbered = pa.table({"query_id": pa.array(np.arange(len(asked))), "embedding": asked["embedding"]})
        found, held = [], 0
        for at, stored in of_cell.items():
            some = np.nonzero(wanted[:, at])[0]
            if len(some):
                found.append(_cell_topk(numbered.take(pa.array(some)), stored, k))
                held += len(found[-1])
            if held > FOUND_ROWS:
                found = [_merged(found, k)]
                held = len(found[0])
        if found:
            best = _merged(found, k)
            yield from best.set_column(0, "query_id", asked["query_id"].take(best["query_id"].combine_chunks())).to_batches()


def _search(rows: DataFrame, choose: Choose, cells: Cells, index: PivotIndex, k: int) -> DataFrame:
    """Best ``k`` of each group's chosen cells for (query_id, embedding[, s]): query_id, vec_id, similarity,
    rounded."""
    schema = (
        f"query_id {rows.schema['query_id'].dataType.simpleString()}, "
        f"vec_id {index.vectors.schema['vec_id'].dataType.simpleString()}, similarity double, rounded double"
    )
    # A slice of a group meets the group's queries in blocks; a vector is sent once for each block.
    n = max(int(cells.n.sum()), rows.count())
    size = max(PART_ROWS, min(-(-n // GROUP_SHARE), GROUP_BYTES // (8 * max(1, cells.pivot.shape[1]))))
    group = _groups(cells, size)
    slices = np.ceil(np.bincount(group, cells.n) / size).astype(int)
    sent = _sent(rows, choose, group)
    counted = {r.group: r["count"] for r in sent.groupBy("group").count().collect()}
    spark = rows.sparkSession
    known = spark.createDataFrame(
        [
            (int(c), int(g), max(1, int(slices[g])), -(-counted[g] // size))
            for c, g in zip(cells.cell, group, strict=True)
            if g in counted
        ],
        "cell long, group long, slices long, blocks long",
    )

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    by_group = known.select("group", "slices", "blocks").distinct()
    left = sent.join(by_group, "group").select(
        *sent.columns, F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), each("slices").alias("slice")
    )
    right = index.vectors.join(known, "cell").select(
        "cell",
        "group",
        F.pmod(F.xxhash64("vec_id"), F.col("slices")).alias("slice"),
        each("blocks").alias("block"),
        "vec_id",
        "embedding",
    )
    keys = ["group", "block", "slice"]
    tasks = int(sum(max(1, slices[g]) * -(-m // size) for g, m in counted.items()))
    # One stream: a task holds the vectors of a slice, and the queries pass by in batches.
    right = right.withColumnRenamed("embedding", "vector")
    sides = {f.name: f.dataType for f in (*left.schema, *right.schema)}
    both = [
        some.select(
            *keys,
            F.lit(some is left).alias("asks"),
            *(
                (F.col(c) if c in some.columns else F.lit(None).cast(kind)).alias(c)
                for c, kind in sides.items()
                if c not in keys
            ),
        )
        for some in (left, right)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answers(batches, keys, choose, cells, k)

    return (
        both[0]
        .union(both[1])
        .repartition(max(1, tasks), *keys)
        .sortWithinPartitions(*keys, "asks")
        .mapInArrow(run, schema)
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rounded"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def pivot_topk(
    queries: DataFrame, index: PivotIndex, k: int, compared: Compared | None = None
) -> DataFrame:
    """Best ``k`` vectors per query by cosine similarity, ties by key, as ``similarity.vector_topk``."""
    # A query without an id finds nothing; one of m rows with an id counts m times.
    repeated = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    unit = materialize(
        queries.filter("query_id IS NOT NULL")
        .join(repeated, "query_id", "left")
        .select(
            "query_id",
            l2_normalize(
                F.coalesce("embedding", F.raise_error(F.lit("VectorSizeError: a query has no vector")))
            ).alias("embedding"),
            F.coalesce("_n", F.lit(1).cast("long")).alias("_n"),
        )
        .select("query_id", "embedding", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
        .drop("_copy")
    )
    cells = Cells(index.cells.collect())
    if not len(cells.cell):
        return unit.select(
            "query_id",
            F.lit(None).cast(index.vectors.schema["vec_id"].dataType).alias("vec_id"),
            F.lit(None).cast("double").alias("similarity"),
            F.lit(0).alias("rank"),
        ).limit(0)

    def nearest(q: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        return cells.first(cells.most(q), k)

    # Scores are rounded before they are compared: the last digit gives way.
    least = 10.0**-SCORE_DIGITS

    def within(q: np.ndarray, s: np.ndarray) -> np.ndarray:
        return cells.most(q) >= s[:, None] - least

    some = _best(_search(unit, nearest, cells, index, k), k)
    # A query that found fewer than k has no bound yet.
    worst = some.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) < k, F.lit(-np.inf)).otherwise(F.min("rounded")).alias("s")
    )
    bounded = materialize(
        unit.join(worst, "query_id", "left").withColumn("s", F.coalesce("s", F.lit(-np.inf)))
    )
    if compared is not None:
        compared.near = _chosen(unit, nearest, cells).count()
        compared.far = _chosen(bounded, lambda q, s: within(q, s) & ~nearest(q, None), cells).count()
        compared.all = unit.count() * len(cells.cell)
    # The nearest cells are within the bound too, and are compared with the others.
    return _best(_search(bounded, within, cells, index, k), k).drop("rounded")

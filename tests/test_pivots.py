"""Search by cells around pivots against comparing all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import pivots as P
from tidemark.operators.similarity import vector_topk


def clustered(seed: int, n: int, dims: int = 12, centres: int = 8, spread: float = 0.15) -> np.ndarray:
    draw = np.random.default_rng(seed)
    rows = draw.normal(size=(centres, dims))[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dims))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frames(spark, queries: np.ndarray, vectors: np.ndarray):
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id long, embedding array<double>")
    stored = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return asked, stored


def rows_of(found) -> list[tuple]:
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.similarity, 8)) for r in found.collect())


@pytest.mark.parametrize(("k", "n_pivots", "part_rows"), [(1, 8, 4096), (7, 20, 16), (30, 3, 50)])
def test_same_result_as_all_pairs(spark, monkeypatch, k, n_pivots, part_rows):
    monkeypatch.setattr(P, "PART_ROWS", part_rows)
    vectors = clustered(k, 400)
    vectors[50:60] = vectors[49]  # ties
    vectors[60] = 0
    vectors[61] *= 3  # not at unit length
    queries = np.concatenate([clustered(k, 30), clustered(99, 10), np.zeros((1, 12)), 5 * vectors[:5]])
    asked, stored = frames(spark, queries, vectors)
    compared = P.Compared()
    got = P.pivot_topk(asked, P.build_pivot_index(stored, n_pivots), k, compared)
    assert rows_of(got) == rows_of(vector_topk(asked, stored, k))
    assert 0 < compared.all <= len(queries) * n_pivots
    if n_pivots == 20:
        assert compared.near + compared.far < 0.9 * compared.all


def test_bounds_hold_for_every_pair():
    vectors, queries = clustered(1, 300), clustered(2, 40)
    pivots = vectors[:10]
    sims = vectors @ pivots.T
    cell = sims.argmax(axis=1)
    angle = np.arccos(np.clip(sims.max(axis=1), -1, 1))

    class Row(dict):
        __getattr__ = dict.__getitem__

    rows = [
        Row(cell=c, pivot=pivots[c], n=int((cell == c).sum()), low=angle[cell == c].min(), high=angle[cell == c].max(), short=1.0, long=1.0)
        for c in range(10)
    ]
    most = P.Cells(rows).most(queries)
    for c in range(10):
        assert (most[:, c] >= (queries @ vectors[cell == c].T).max(axis=1) - 1e-12).all()


def test_fewer_vectors_than_wanted_none_and_stored(spark, tmp_path):
    asked, stored = frames(spark, clustered(3, 4), clustered(4, 5))
    index = P.build_pivot_index(stored, 3)
    assert rows_of(P.pivot_topk(asked, index, 10)) == rows_of(vector_topk(asked, stored, 10))
    P.write_pivot_index(index, str(tmp_path))
    assert rows_of(P.pivot_topk(asked, P.read_pivot_index(spark, str(tmp_path)), 2)) == rows_of(vector_topk(asked, stored, 2))
    assert P.pivot_topk(asked, P.build_pivot_index(stored.limit(0)), 3).count() == 0


def test_queries_travel_once_to_a_group_of_cells(spark, monkeypatch):
    """A query that wants many cells of a group is one row there, and groups of several slices lose nothing."""
    vectors = clustered(5, 300, spread=2.0)
    asked, stored = frames(spark, vectors[:40], vectors)
    index = P.build_pivot_index(stored, 30)
    cells = P.Cells(index.cells.collect())
    sent = P._sent(asked, lambda q, _: np.ones((len(q), 30), bool), P._groups(cells, 100))
    assert sent.count() == 40 * len(set(P._groups(cells, 100))) <= 40 * 4
    monkeypatch.setattr(P, "PART_ROWS", 7)
    assert rows_of(P.pivot_topk(asked, index, 9)) == rows_of(vector_topk(asked, stored, 9))


def test_repeated_and_missing_query_ids(spark):
    """As before groups: two rows with an id count twice each, a row without an id finds nothing."""
    asked, stored = frames(spark, clustered(6, 3), clustered(7, 40))
    twice = asked.filter("query_id < 2").unionByName(asked.filter("query_id = 1"))
    lost = asked.filter("query_id = 2").selectExpr("CAST(NULL AS long) AS query_id", "embedding")
    got = rows_of(P.pivot_topk(twice.unionByName(lost), P.build_pivot_index(stored, 5), 8))
    best = {q: [r[2] for r in rows_of(vector_topk(asked, stored, 8)) if r[0] == q] for q in (0, 1)}
    assert [r[2] for r in got if r[0] == 0] == best[0]
    assert [r[2] for r in got if r[0] == 1] == [v for v in best[1][:2] for _ in range(4)]
    assert {r[0] for r in got} == {0, 1}


POOL = pa.proxy_memory_pool(pa.default_memory_pool())


def test_rows_held_by_a_task_do_not_grow_with_its_cells(monkeypatch):
    """20,000 queries that want all 40 cells of a group find 8 million rows, of which few are held at a time."""
    draw = np.random.default_rng(8)
    queries, vectors = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (draw.normal(size=(n, 4)) for n in (20000, 2000)))

    class Row(dict):
        __getattr__ = dict.__getitem__

    cells = P.Cells([Row(cell=c, pivot=vectors[c], n=50, low=0, high=4, short=1, long=1) for c in range(40)])
    keys = {c: pa.array(np.zeros(20000, np.int64)) for c in ("group", "block", "slice")}
    gone = pa.nulls(20000, pa.int64())
    of_query = keys | {"asks": pa.array(np.ones(20000, bool)), "cell": gone, "vec_id": gone}
    of_query |= {"vector": pa.nulls(20000, pa.list_(pa.float64())), "query_id": pa.array(np.arange(20000)), "embedding": pa.array(list(queries))}
    of_vector = {c: a[:2000] for c, a in of_query.items()} | {"asks": pa.array(np.zeros(2000, bool)), "query_id": gone[:2000]}
    of_vector |= {"cell": pa.array(np.arange(2000) % 40), "vec_id": pa.array(1000 + np.arange(2000)), "vector": pa.array(list(vectors))}
    of_vector["embedding"] = pa.nulls(2000, pa.list_(pa.float64()))
    stream = [pa.record_batch(of_vector), pa.record_batch(of_query)]
    usual, got, rows = pa.default_memory_pool(), {}, 0
    pa.set_memory_pool(POOL)
    try:
        for found in P._answers(iter(stream), list(keys), lambda q, _: np.ones((len(q), 40), bool), cells, 10):
            rows += len(found)
            for q, v in zip(found["query_id"].to_pylist(), found["vec_id"].to_pylist(), strict=True):
                got.setdefault(q, []).append(v)
        del found
    finally:
        pa.set_memory_pool(usual)
    assert rows == 20000 * 10
    for q in (0, 4095, 4096, 19999):
        assert got[q] == (1000 + np.argsort(-(vectors @ queries[q]), kind="stable")[:10]).tolist()
    assert POOL.max_memory() < 100 << 20

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.numeric import dot, l2_normalize
from tidemark.operators import embedding as E
from tidemark.operators import lexical as B
from tidemark.operators import search as H
from tidemark.operators import similarity as V
from tidemark.plans.search import product_search

DOCS = [(1, "red apple pie"), (2, "green apple"), (3, "blue sky blue"), (4, "")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query_text string")


def plain_bm25(query, doc, corpus):
    words = [t.split() for _, t in corpus]
    avgdl = sum(map(len, words)) / len(words)
    score = 0.0
    for term in query.split():
        tf = doc.split().count(term)
        df = sum(term in w for w in words)
        idf = math.log((len(words) - df + 0.5) / (df + 0.5) + 1)
        score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(doc.split()) / avgdl))
    return score


@pytest.mark.parametrize("restricted", [True, False])
def test_bm25_scores(spark, restricted):
    asked = queries(spark, [(1, "apple pie apple"), (2, "blue"), (3, "nothing"), (4, "")])
    index = B.build_index(docs(spark), asked if restricted else None)
    got = {(r.query_id, r.doc_id): r.score for r in B.bm25_topk(index, asked, 10).collect()}
    want = {(1, 1): "apple pie apple", (1, 2): "apple pie apple", (2, 3): "blue"}
    assert set(got) == set(want)
    for (q, d), text in want.items():
        assert got[(q, d)] == pytest.approx(plain_bm25(text, dict(DOCS)[d], DOCS))


def test_bm25_ties_in_document_order_and_stored_index(spark, tmp_path):
    frame = docs(spark, [(9, "x y"), (2, "x y"), (5, "x y")])
    B.write_index(B.build_index(frame), str(tmp_path))
    top = B.bm25_topk(B.read_index(spark, str(tmp_path)), queries(spark, [(1, "x")]), 2)
    assert [r.doc_id for r in top.orderBy("rank").collect()] == [2, 5]


def test_bm25_tasks_grow_with_the_joined_rows(spark, monkeypatch):
    """Few postings asked for by many queries are many rows: their number decides how many tasks add them up."""
    monkeypatch.setattr(B, "PARTS_A_TASK", 4)
    index = B.materialize_index(B.build_index(docs(spark, [(i, "x y") for i in range(8)])))
    scores = B.bm25_scores(index, queries(spark, [(q, "x") for q in range(3)]))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert ", 6), REPARTITION_BY_NUM" in plan and "hashpartitioning(query_id" not in plan
    assert scores.count() == 24


def test_word_counting_tasks_grow_with_the_texts(spark, monkeypatch):
    rows = [(i, "x y " * 10) for i in range(20)]
    monkeypatch.setattr(X, "CHARS_A_TASK", 50)
    postings = B.build_index(docs(spark, rows), queries(spark, [(1, "x z")])).postings
    assert postings.rdd.getNumPartitions() == 16  # 800 characters
    assert sorted(postings.select("doc_id", "dl", "term", "tf").collect()) == [(i, 20, "x", 10) for i, _ in rows]
    vectors = E.hashed_embedding(docs(spark, rows).withColumnRenamed("doc_id", "id"))
    assert vectors.rdd.getNumPartitions() == 16


def test_empty_corpus(spark):
    stats = B.corpus_stats(docs(spark, [])).first()
    assert (stats.n_docs, stats.avgdl) == (0, 0.0)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_vector_topk_is_exact_for_any_block_size(spark):
    rng = np.random.default_rng(3)
    stored = rng.normal(size=(300, 8))
    stored /= np.linalg.norm(stored, axis=1, keepdims=True)
    stored[100:200] = stored[7]  # a third of all rows are copies
    asked = rng.normal(size=(25, 8)) * 5
    table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(stored)]).repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    sims = np.round(asked / np.linalg.norm(asked, axis=1, keepdims=True) @ stored.T, 9)
    want = {i: sorted(range(300), key=lambda v: (-sims[i, v], v))[:12] for i in range(25)}
    for block_bytes in (1 << 20, 8 * 8 * 4):
        got = V.vector_topk(q, table, 12, block_bytes).collect()
        for i in want:
            assert [r.vec_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == want[i]


def test_vector_cells_meet_when_partitions_are_not_merged(spark):
    rng = np.random.default_rng(3)
    stored = [(i, l.tolist()) for i, l in enumerate(rng.normal(size=(60, 4)))]
    asked = vectors(spark, stored[:20]).withColumnRenamed("vec_id", "query_id")
    want = {(r.query_id, r.vec_id) for r in V.vector_topk(asked, vectors(spark, stored), 5).collect()}
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = V.vector_topk(asked, vectors(spark, stored), 5, block_bytes=8 * 4 * 8).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(got) == 100 and {(r.query_id, r.vec_id) for r in got} == want


def test_vector_topk_with_other_keys_and_without_vectors(spark):
    table = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], "vec_id string, embedding array<double>")
    asked = spark.createDataFrame([(3, [2.0, 0.0])], "query_id smallint, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.rank) for r in V.vector_topk(asked, table, 2).collect()] == [(3, "a", 1), (3, "b", 2)]
    assert V.vector_topk(asked.limit(0), table, 2).collect() == []
    assert V.vector_topk(asked, table.limit(0), 2).collect() == []
    none = spark.createDataFrame([(1, None)], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="VectorSizeError"):
        V.vector_topk(none, table, 2).collect()


def test_vector_checks(spark):
    table = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert V.checked_vectors(table, 2, 2) is table
    for count, dims in ((3, 2), (2, 3)):
        with pytest.raises(V.VectorSizeError):
            V.checked_vectors(table, count, dims)
    wrong = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="VectorSizeError"):
        V.vector_topk(wrong, table, 1).collect()


def test_normalise_and_dot(spark):
    frame = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = frame.select(l2_normalize(F.col("a")).alias("a"), l2_normalize(F.col("z")).alias("z"), dot(F.col("a"), F.col("a")).alias("d")).first()
    assert row.a == [0.6, 0.8] and row.z == [0.0, 0.0] and row.d == 25.0
    with pytest.raises(Exception, match="vector sizes differ"):
        frame.select(dot(F.col("a"), F.array(F.lit(1.0)))).collect()


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank int")


def test_rrf(spark):
    first = ranking(spark, [(1, 10, 1), (1, 20, 2)])
    second = ranking(spark, [(1, 20, 1), (1, 30, 2), (2, 5, 1)])
    got = H.rrf_fuse([first, second], 3).orderBy("query_id", "position").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 20), (1, 10), (1, 30), (2, 5)]
    assert got[0].fusion_score == pytest.approx(1 / 62 + 1 / 61)
    assert [r.doc_id for r in H.rrf_fuse([ranking(spark, [(1, 8, 1)]), ranking(spark, [(1, 3, 1)])], 8).orderBy("position").collect()] == [8, 3]


def outcome(spark, scores, candidates=((1, 10), (1, 20))):
    c = spark.createDataFrame(list(candidates), "query_id long, doc_id long")
    s = spark.createDataFrame([(1, d, p, r) for p, (d, r) in enumerate(scores)], "query_id long, doc_id long, position int, relevance double")
    return H.search_outcome(queries(spark, [(1, "q")]), c, s).first()


def test_outcomes_at_the_thresholds(spark):
    assert (o := outcome(spark, [(10, 0.75), (20, 0.1)])).outcome == "auto_selected" and o.selected_code == 10
    assert outcome(spark, [(10, 0.7499)]).outcome == "disambiguate"
    assert outcome(spark, [(10, 0.35)]).outcome == "disambiguate"
    assert (o := outcome(spark, [(10, 0.3499)])).outcome == "no_candidates_found" and o.ranked is None
    assert outcome(spark, []).error_code == "RERANK_INVALID_CANDIDATE"  # candidates without scores
    assert [r.doc_id for r in outcome(spark, [(20, 0.5), (10, 0.5)]).ranked] == [20, 10]


def test_one_foreign_or_invalid_code_voids_the_query(spark):
    for scores in ([(10, 0.9), (99, 0.1)], [(10, 1.1)], [(10, 0.5)] * 9):
        o = outcome(spark, scores)
        assert (o.error_code, o.outcome, o.ranked) == ("RERANK_INVALID_CANDIDATE", None, None)


def test_code_pattern(spark):
    c = spark.createDataFrame([(1, "010121"), (1, "x")], "query_id long, doc_id string")
    s = spark.createDataFrame([(1, "x", 1, 0.9)], "query_id long, doc_id string, position int, relevance double")
    rule = F.col("doc_id").rlike(r"^\d{6}$")
    assert H.search_outcome(queries(spark, [(1, "q")]), c, s).first().outcome == "auto_selected"
    assert H.search_outcome(queries(spark, [(1, "q")]), c, s, rule).first().error_code == "RERANK_INVALID_CANDIDATE"


def test_floor(spark):
    lexical = ranking(spark, [(1, 10, 1)])
    similar = spark.createDataFrame([(1, 10, 0.1), (2, 10, 0.34), (3, 10, 0.35)], "query_id long, doc_id long, similarity double")
    assert [r.query_id for r in H.floored_queries(lexical, similar).collect()] == [2]


def test_product_search_with_rewrite(spark):
    frame = docs(spark, [(1, "poppy seeds"), (2, "beef meat"), (3, "sunflower oil")])
    asked = queries(spark, [(1, " posta dana "), (2, "beef meat"), (3, "qqq"), (4, ""), (5, "zzz")])
    rewrites = spark.createDataFrame([("posta dana", "poppy seeds"), ("zzz", "also unknown")], "variant string, term string")
    vecs = E.hashed_embedding(frame.withColumnRenamed("doc_id", "id")).withColumnRenamed("id", "vec_id")
    got = {r.query_id: r for r in product_search(asked, frame, B.build_index(frame), vecs, rewrites).collect()}
    assert got[1].is_rewritten and got[1].outcome == "auto_selected" and got[1].selected_code == 1
    assert not got[2].is_rewritten and got[2].selected_code == 2
    assert got[3].outcome == "no_candidates_found" and not got[3].is_rewritten
    assert got[4].error_code == "EMPTY_TEXT" and got[4].outcome is None
    assert got[5].is_rewritten and got[5].outcome == "no_candidates_found"


def test_hashed_embedding_and_user_model(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "")], "id long, text string")
    rows = {r.id: r.embedding for r in E.hashed_embedding(texts, 16).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1.0) and rows[2] == [0.0] * 16
    model = lambda batch: np.array([[len(t), 0.0] for t in batch])
    rows = {r.id: list(r.embedding) for r in E.embed_with(texts, model, 2, batch=1).collect()}
    assert rows == {1: [1.0, 0.0], 2: [0.0, 0.0]}
    with pytest.raises(Exception, match="embedder returned"):
        E.embed_with(texts, model, 3).collect()


def test_incremental_embedding(spark, tmp_path):
    path = str(tmp_path / "vectors")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    calls = []

    def embed(todo):
        calls.append(sorted(r.id for r in todo.collect()))
        return E.hashed_embedding(todo, 4)

    assert E.update_vectors(first, path, embed) == 2
    assert E.update_vectors(first, path, embed) == 0
    changed = spark.createDataFrame([(1, "a"), (2, "new"), (3, "c")], "id long, text string")
    assert E.update_vectors(changed, path, embed) == 2
    assert calls == [[1, 2], [2, 3]]
    assert E.latest_vectors(spark.read.parquet(path)).count() == 3


def test_score_tasks_grow_with_the_rows(spark, monkeypatch):
    """Scores are dealt by their number, not by their compressed size."""
    monkeypatch.setattr(H, "SCORES_A_TASK", 4)
    rows = [(q, d, d, 0.5 + 0.1 * d) for q in range(5) for d in range(4)]
    scores = spark.createDataFrame(rows, "query_id int, doc_id int, position int, relevance double")
    asked = scores.select("query_id").distinct()
    outcome = H.search_outcome(asked, scores.select("query_id", "doc_id", "position"), scores)
    assert ", 5), REPARTITION_BY_NUM" in outcome._jdf.queryExecution().executedPlan().toString()
    assert {(r.outcome, r.selected_code) for r in outcome.collect()} == {("auto_selected", 3)}

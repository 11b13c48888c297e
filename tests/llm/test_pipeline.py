"""The pipeline against a plain version of each stage; every query on awkward and on empty tables."""

from collections import defaultdict

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import language, secret_scan
from tidemark.llm.common import read
from tidemark.llm.queries import ORACLE, QUERIES
from tidemark.session import materialize

from .conftest import awkward_rows, words, write
from .test_dedup import brute_groups, near_copies
from .test_search_and_scan import SYLLABLES, speech
from .test_tokens import check_packing


def corpus() -> list[tuple]:
    boiler = "This site uses cookies to serve you on day {}"
    rows = [
        (i, f"{boiler.format(i)}\n{speech(lang, i, 60)}" if i % 2 else speech(lang, i, 60), lang, "s")
        for i, lang in enumerate(list(SYLLABLES) * 12)
    ]
    rows += [(1000 + i, text, "en", "copies") for i, (_, text) in enumerate(near_copies(3, 12))]
    rows += [(2000, "password=hunter2hunter2 " + words(5, 30), "en", "x"), (2001, "12 34", "en", "x"), (2002, None, "fr", "x")]
    return rows


def plain(rows: list[tuple], model: language.Model) -> dict[int, str]:
    """Texts by id after the first four stages."""
    kept = []
    for doc_id, text, *_ in rows:
        lang, score = model.predict(text or "")
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            kept.append((doc_id, text))
    documents = pd.DataFrame(kept, columns=["doc_id", "text"])  # noqa: F841
    cut = duckdb.sql(ORACLE["op2_line_templates"]).fetchall()
    texts = {i: text for i, _, n, text in cut if not n or text.strip(" \t\r\n")}
    groups = brute_groups(sorted(texts.items()), 5, 80)
    return {i: secret_scan.redacted(t) for i, t in texts.items() if groups[i] == i}


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows = corpus()
    folder = write(tmp_path, rows, [])
    docs = read(spark, folder, "documents")
    expect = plain(rows, language.fit(docs))
    assert 40 < len(expect) < len(rows) - 5
    source = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder))
        assert docs.columns == source.columns
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == expect and len(got) == len(expect)
    assert any("[SECRET]" in t for t in expect.values())
    by_id = defaultdict(list)
    for i, text in expect.items():
        by_id[i].append(text)
    check_packing(corpus_pipeline.run(spark, folder).collect(), by_id)


def test_pipeline_on_awkward_rows(spark, awkward):
    packed = corpus_pipeline.run(spark, awkward).collect()
    assert {r["doc_id"] for r in packed} <= {r[0] for r in awkward_rows()}
    assert 4 in {r["doc_id"] for r in packed} and 5 not in {r["doc_id"] for r in packed}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).collect() == []


def test_pipeline_on_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows_give_one_result_each(spark, awkward, name):
    rows = QUERIES[name](spark, awkward).collect()
    if name not in ("op4_harmonic_packing", "op6_exact_topk"):
        assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in awkward_rows()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expect = con.sql(ORACLE[name])
    got = QUERIES[name](spark, folder).select(*expect.columns).collect()
    assert sorted(map(tuple, got)) == sorted(expect.fetchall())


def test_near_dedup_keeps_other_texts_of_an_id(spark):
    rows = [(1, words(1, 30)), (1, words(2, 30)), (1, words(2, 30)), (2, words(2, 30)), (None, words(1, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[1], rows[4]], key=repr)

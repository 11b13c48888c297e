"""Merkle manifests against a tree built node by node, and against their SQL."""

import hashlib
import zlib
from itertools import groupby

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.queries import ORACLE, QUERIES

from .conftest import awkward_rows


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    fields = [doc_id, source, lang, n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def tree(nodes: list[str], arity: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and for each leaf the siblings before and after it, level by level."""
    paths: list[list] = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for k, place in enumerate(at):
            run, slot = runs[place // arity], place % arity
            paths[k].append((run[:slot], run[slot + 1 :]))
            at[k] = place // arity
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows: list[tuple], arity: int) -> list[tuple]:
    """rows are (doc_id, source, lang, n_chars, text)."""
    low = lambda v: (v is not None, v if not isinstance(v, str) else v.encode())
    ordered = sorted(((low(r[1]), low(r[0]), leaf(*r), r) for r in rows), key=lambda x: x[:3])
    trees = []
    for _, group in groupby(ordered, key=lambda x: x[0]):
        members = list(group)
        trees.append((members, *tree([m[2] for m in members], arity)))
    root, tops = tree([t[1] for t in trees], arity) if trees else (None, [])
    out = []
    for (members, subroot, paths), top in zip(trees, tops, strict=True):
        for (_, _, own, row), path in zip(members, paths, strict=True):
            doc_id, source, lang, n_chars, text = row
            start = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                start = leaf(doc_id, source, lang, n_chars, text and text.replace("\n", ""))
            for before, after in path + top:
                start = h(*before, start, *after)
            proof = h(*[d for before, after in path + top for d in before + after])
            out.append((doc_id, own, subroot, root, proof, start, start == root))
    return sorted(out, key=str)


def frame(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as number", "'x' as tree", "'y' as digest", "2 as size")


def sample(sizes: dict) -> list[tuple]:
    rows, doc_id = [], -3
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc_id, source, "en" if doc_id % 3 else None, doc_id * 7, f"text {doc_id}\nof {source}"))
            doc_id += 1
    return rows


@pytest.mark.parametrize(
    ("sizes", "arity"),
    [
        ({"a": 1}, 3),
        ({"a": 3}, 3),
        ({"a": 28, None: 4, "b": 1, "": 2, "é": 5, "z": 3, "B": 2}, 3),
        ({f"s{i}": 1 for i in range(11)}, 3),
        ({"a": 9, "b": 6}, 2),
    ],
)
def test_trees_equal_brute_force(spark, sizes, arity):
    rows = sample(sizes)
    got = sorted((tuple(r) for r in manifest.verified(frame(spark, rows), arity).collect()), key=str)
    assert got == brute(rows, arity)
    flags = {r[6] for r in got}
    assert flags <= {True, False}


def test_awkward_rows_and_sql(spark, awkward, nothing):
    rows = [(i, source, lang, None if t is None else len(t), t) for i, t, lang, source in awkward_rows()]
    got = sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, awkward).collect()), key=str)
    assert got == brute(rows, 3)
    db = duckdb.connect()
    db.execute(f"create view documents as from '{awkward}/documents.parquet'")
    assert sorted(db.execute(ORACLE["op12_merkle_manifest"]).fetchall(), key=str) == got
    empty = QUERIES["op12_merkle_manifest"](spark, nothing)
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert empty.count() == 0


def test_numbers_of_a_hot_group_come_from_many_ranges(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("v"), "id"
    )
    got = manifest.numbered(rows, ["g"], ["v", "id"]).collect()
    for group, size in (("hot", 4000), (None, 1000)):
        mine = sorted((r for r in got if r.g == group), key=lambda r: (r.v, r.id))
        assert [r.number for r in mine] == list(range(size)) and {r.size for r in mine} == {size}

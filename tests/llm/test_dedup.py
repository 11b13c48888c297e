"""Dedup operators against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import line_templates, near_duplicates, repeats
from tidemark.llm.components import components
from tidemark.llm.queries import ORACLE, QUERIES

from .conftest import awkward_rows, words


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(text: str | None, size: int) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(found) < size:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


def brute_groups(rows, size: int, percent: int) -> dict:
    """Smallest reachable id of each id, by comparing every pair."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = defaultdict(set)
    for i, text in rows:
        if i is not None:
            sets[i].add(shingles(text, size))
    group = {i: i for i in ids}

    def linked(a, b) -> bool:
        return any(
            x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]
        )

    changed = True
    pairs = [(a, b) for a in ids for b in ids if a < b and linked(a, b)]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def near_copies(seed: int, n: int) -> list[tuple]:
    """Copies of one text with more and more words changed: some pairs are links, some nearly."""
    draw = random.Random(seed)
    base = words(seed, 120).split()
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(draw.randint(0, 8)):
            own[draw.randrange(len(own))] = words(draw.randrange(10**6), 1)
        rows.append((1000 * seed + i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rows = near_copies(1, 60) + near_copies(2, 25) + [(9000 + i, words(i, 50)) for i in range(20)]
    got = near_duplicates.near_duplicates(docs_of(spark, rows), size, percent).collect()
    expect = brute_groups(rows, size, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == expect
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t, size)) for i, t in rows}
    assert len(set(expect.values())) < len(rows) - 20  # there were links


def test_near_duplicates_of_awkward_rows(spark, awkward):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = QUERIES["op3_superminhash"](spark, awkward).collect()
    assert len(got) == len(rows)
    expect = brute_groups(rows, 3, 85)
    for r in got:
        assert r["component_id"] == (expect[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    common, own = draw.integers(0, 1 << 63, 800).astype(np.uint64), draw.integers(0, 1 << 63, 200).astype(np.uint64)
    a, b = np.sort(common), np.sort(np.concatenate([common[:600], own]))
    h = near_duplicates.super_min_hash([a, b, a[:1], a[:0]], 256)
    assert abs(float((h[0] == h[1]).mean()) - 0.6) < 0.1
    assert sorted((h[2] >> np.uint64(32)).tolist()) == list(range(256))  # one element fills every slot once


def test_miss_probability():
    for threshold in (0.8, 0.85):
        rows = near_duplicates.rows_per_band(threshold)
        assert (1 - threshold**rows) ** near_duplicates.BANDS <= near_duplicates.MISS


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 150), (150, 200)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100, 200: 150}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(rows) -> list[tuple]:
    out, seen = [], {}
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0])
    for doc_id, text in order:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], -(1 << 63) if doc_id is None else doc_id)
    for doc_id, text in order:
        raw, key = (text or "").encode(), -(1 << 63) if doc_id is None else doc_id
        covered = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < key:
                covered[i : i + 50] = True
        kept = bytes(b for b, c in zip(raw, covered, strict=False) if not c)
        spans = int(np.count_nonzero(covered[1:] & ~covered[:-1]) + covered[0])
        out.append((doc_id, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark, awkward):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    got = QUERIES["op8_suffix_repeats"](spark, awkward).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_repeats_with_hot_anchors_and_runs(spark, monkeypatch):
    """Passages with changing surroundings, runs of one character, repeats just under and over 50."""
    monkeypatch.setattr(repeats, "HOT", 4)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    passage = words(77, 30)
    rows = [(i, f"{words(i, 20)} {passage[: 40 + 3 * i]} {words(500 + i, 15)}") for i in range(25)]
    rows += [(100, "a" * 49), (101, "a" * 50), (102, "a" * 700), (103, "b" + "a" * 50 + "c"), (104, "é" * 40)]
    got = repeats.removed(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_line_templates_equal_sql(spark, tmp_path):
    rows = [
        (i, "\n".join([
            words(i, 12),
            f"Posted by user{i % 7} on day {i}",
            "All rights   reserved.\t2020" if i % 2 else "All rights reserved. 1999",
            f"see more articles about {words(i, 1)} in this long section of ours",
            "",
            "short",
        ]))
        for i in range(30)
    ] + [(50, ""), (51, None), (52, "\n\n")]
    docs = docs_of(spark, rows)
    got = sorted(map(tuple, line_templates.line_report(docs).collect()))
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got == sorted(con.sql(ORACLE["op2_line_templates"]).fetchall())
    assert [r[2] for r in got][:2] == [0, 3]  # the first document keeps its lines
    kept = dict((r[0], r[3]) for r in got)
    assert "short" in kept[5] and "reserved" not in kept[5] and "Posted" not in kept[5] and "section" not in kept[5]


def test_line_templates_keep_rows_and_columns(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    done = line_templates.drop_recurring(docs)
    assert done.columns == docs.columns
    rows = done.collect()
    assert len(rows) == len(awkward_rows())
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in rows)
    assert sum("Header" in (r["text"] or "") for r in rows) == 1


def test_a_copy_without_any_line_left_goes(spark):
    text = "\n".join(words(i, 10) for i in range(5))
    done = line_templates.drop_recurring(docs_of(spark, [(i, text) for i in range(12)]))
    assert [tuple(r) for r in done.collect()] == [(0, text)]


def left_of(spark, rows: list[tuple]) -> dict:
    """Texts by id after the pipeline's line dedup."""
    done = corpus_pipeline.line_dedup(spark, docs_of(spark, rows), "")
    return {r["doc_id"]: r["text"] for r in done.collect()}


def test_short_and_rare_copies_of_lines_go(spark):
    """Lines of one token, scripts without blanks, and long lines that only two documents share."""
    rare, chinese = "a long line that two documents share", "这是一个没有空格的段落也应该被认出来是重复的内容。"
    rows = [(i, f"Menu\n{words(i, 9)}\n{i} {i + 1}\n\nend") for i in range(12)]
    rows += [(20, f"{words(20, 9)}\n{rare}\n{chinese}\nAh"), (21, f"{words(21, 9)}\n{rare} \n{chinese}\nAh")]
    got = left_of(spark, rows)
    assert got[0] == rows[0][1] and got[20] == rows[12][1]
    assert all(got[i] == f"{words(i, 9)}\n{i} {i + 1}\n" for i in range(1, 12))
    assert got[21] == f"{words(21, 9)}\nAh"


def test_several_templates_of_one_leaf_go(spark):
    """Two templates with the same leading tokens, neither of which has a majority, and lines of neither."""
    rows = []
    for i in range(50):
        name = words(900 + i, 1)
        line = f"Share this on Facebook with your friend {name}" if i % 2 else f"Share this on Twitter using your account {name}"
        rows.append((i, f"{words(i, 9)}\n{line if i % 5 else 'Share this on ' + words(700 + i, 5)}"))
    got = left_of(spark, rows)
    stay = {1, 2} | set(range(0, 50, 5))
    assert got == {i: text if i in stay else text.split("\n")[0] for i, text in rows}


def test_rows_of_numbers_and_short_lists_stay(spark):
    """Fields and leading words alone make no template; a line with a field and constant words does."""
    rows = [
        (i, f"{i} {i + 1} {2 * i}\n{i} {i} {i} kg\nThe capital of {words(600 + i, 1)}\nPosted by user{i} on day {i}\n{words(i, 9)}")
        for i in range(20)
    ] + [(100 + i, f"{i} 77 {i}\n{i} 78 {i}") for i in range(12)]
    got = left_of(spark, rows)
    assert got == {i: text if i == 0 or i >= 100 else text.replace(f"Posted by user{i} on day {i}\n", "") for i, text in rows}

"""Runs of words against trying every period at every place."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import periodic
from tidemark.llm.queries import QUERIES

from .conftest import awkward_rows


def brute(words: list) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def contract(doc_id, text) -> dict:
    """The digests by the letter of the contract."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best[0],
        "length": best[1],
        "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if runs else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    }


def periodic_text(draw: random.Random) -> str:
    letters = draw.choice(["a", "ab", "abc", "abcde", [str(k) for k in range(50)]])
    words = [draw.choice(letters) for _ in range(draw.randint(0, 120))]
    if draw.random() < 0.6 and len(words) > 20:
        a = draw.randrange(len(words) - 10)
        p = draw.randint(1, (len(words) - a) // 2 + 1)
        for i in range(a, min(len(words), a + draw.randint(p, 4 * p + 12))):
            words[i] = words[a + (i - a) % p]
    if draw.random() < 0.3:
        words += words[: draw.randint(0, len(words))]
    return draw.choice([" ", "\n", " \t"]).join(words)


def test_runs_equal_brute_force():
    draw = random.Random(5)
    n = 0
    for _ in range(500):
        batch = [periodic_text(draw) for _ in range(draw.randint(1, 4))]
        for text, got in zip(batch, periodic.block_runs([t.encode() for t in batch]), strict=True):
            expect = brute(text.split())
            assert got == expect, text
            n += len(expect)
    assert n > 500


def fibonacci(n: int) -> list[str]:
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "words",
    [
        ["ha"] * 11,
        ["ha"] * 12,
        ["ha"] * 500,
        fibonacci(400),
        ["x", *["a", "b", "c"] * 4, "y"],
        ["x", *["a", "b", "c"] * 3, "a", "b", "y"],  # eleven words
        [str(i) for i in range(300)] * 2,
        [*[str(i) for i in range(300)], "gap", *[str(i) for i in range(300)]],  # one word too far
    ],
)
def test_edges(words):
    assert periodic.block_runs([" ".join(words).encode()]) == [brute(words)]


def test_words_with_colliding_polynomials_stay_apart():
    one = b"a"
    for _ in range(10):
        one += bytes(195 - c for c in one)
    other = bytes(195 - c for c in one)
    text = b" ".join([one] * 7 + [other] * 7)
    assert periodic.block_runs([text]) == [[]]
    assert periodic.block_runs([b" ".join([one, other] * 6)]) == [[(0, 12, 2)]]


def test_long_text_of_one_word():
    assert periodic.block_runs([b"la " * 60_000]) == [[(0, 60_000, 1)]]


def test_query_equals_the_contract(spark, awkward, nothing):
    got = {}
    for row in QUERIES["op13_periodic_runs"](spark, awkward).collect():
        got.setdefault(row.doc_id, []).append(row.asDict())
    for doc_id, text, *_ in awkward_rows():
        if text is None or len(text) < 5000:
            assert contract(doc_id, text) in got[doc_id]
    assert sum(map(len, got.values())) == len(awkward_rows())
    assert QUERIES["op13_periodic_runs"](spark, nothing).count() == 0


def test_operator_on_rows(spark):
    draw = random.Random(8)
    rows = [(i, periodic_text(draw)) for i in range(200)] + [(None, "a " * 30), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as starts", "1 as runs")
    report = sorted(map(str, (r.asDict() for r in periodic.run_report(docs).collect())))
    assert report == sorted(str(contract(i, t)) for i, t in rows)
    found = sorted(str((r.doc_id, list(zip(r.starts, r.lengths, r.periods, strict=True)))) for r in periodic.periodic_runs(docs).collect())
    assert found == sorted(str((i, brute((t or "").split()))) for i, t in rows)
    by_text = {(r.doc_id, r.text) for r in periodic.collapse(docs).collect()}
    assert (None, "a") in by_text and (7, "") in by_text

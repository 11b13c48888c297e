"""Interval labels against walking the tree."""

import random

from tidemark.operators import hierarchy as N
from tidemark.operators import ranges


def random_tree(seed: int, n: int) -> dict:
    """Parents of n codes: bushy, a long chain, a node with most children, unknown parents."""
    draw, parent = random.Random(seed), {}
    for i in range(n):
        kind = i % 4
        up = {0: draw.randrange(i) if i else None, 1: i - 1 if i else None, 2: 0, 3: None}[kind]
        parent[f"c{i:03d}"] = None if up is None or i == 0 else f"c{up:03d}"
    parent["c003"] = "nowhere"
    for i in range(n, n + 60):  # a deep chain
        parent[f"c{i:03d}"] = f"c{i - 1:03d}"
    return parent


def chain(parent: dict, code: str) -> list:
    out = []
    while parent[code] in parent and parent[code] is not None:
        code = parent[code]
        out.append(code)
    return out


def frame(spark, parent: dict):
    return spark.createDataFrame(list(parent.items()), "code string, parent string")


def test_labels_and_totals(spark):
    parent = random_tree(1, 80)
    labels = N.label(frame(spark, parent)).cache()
    at = {r.code: (r.enter, r.leave) for r in labels.collect()}
    assert sorted(x for pair in at.values() for x in pair) == list(range(2 * len(parent)))
    for a in parent:
        up = set(chain(parent, a))
        for b in parent:
            assert (at[b][0] < at[a][0] and at[a][1] < at[b][1]) == (b in up)
    deep = max(parent, key=lambda c: len(chain(parent, c)))
    assert [r.code for r in N.above(labels, deep).collect()] == chain(parent, deep)[::-1]
    top = chain(parent, deep)[-1]
    assert {r.code for r in N.below(labels, top).collect()} == {c for c in parent if top in chain(parent, c)}
    values = spark.createDataFrame([(c, i) for i, c in enumerate(parent) if i % 3], "code string, v long")
    got = {r.code: r.v for r in N.totals_below(labels, values, ["v"]).collect()}
    own = {c: i if i % 3 else 0 for i, c in enumerate(parent)}
    assert got == {c: own[c] + sum(own[x] for x in parent if c in chain(parent, x)) for c in parent}


def test_cycles_are_reported(spark):
    parent = {"a": None, "b": "a", "x": "y", "y": "z", "z": "x", "below": "x", "self": "self"}
    labels = N.label(frame(spark, parent))
    assert {r.code for r in N.cycles(labels).collect()} == {"x", "y", "z", "below", "self"}
    assert {r.code for r in labels.filter("enter is not null").collect()} == {"a", "b"}


def test_one_node_and_none(spark):
    assert [tuple(r) for r in N.label(frame(spark, {"a": "gone"})).collect()] == [("a", 0, 1)]
    assert N.label(spark.createDataFrame([], "code string, parent string")).count() == 0


def test_running_totals_of_a_hot_group(spark):
    draw = random.Random(3)
    rows = [(None if i % 7 == 0 else "hot" if i % 7 < 5 else f"g{i % 3}", i, draw.randint(-5, 9)) for i in range(2000)]
    got = ranges.running(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], ["i"], {"so_far": "v"}).collect()
    for group in {g for g, _, _ in rows}:
        own, total = [r for r in rows if r[0] == group], 0
        mine = {r.i: (r.number, r.so_far) for r in got if r.g == group}
        for n, (_, i, v) in enumerate(own):
            assert mine[i] == (n, total)
            total += v

"""The cell store against computing all cells again."""

import random

import pytest

from tidemark.operators import cellstore as C

RECORDS = "item_code string, flow string, year int, partner_code string, partner_name string, value double, is_provisional boolean, seq long"


def records(spark, seed: int, n: int = 300):
    draw = random.Random(seed)
    rows = [
        (draw.choice("xyz"), draw.choice(["import", "export"]), draw.randint(2019, 2022), draw.choice("1234"), draw.choice([None, "a", "b"]), draw.choice([None, 1.0, 2.5, draw.random()]), draw.random() < 0.2, i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, RECORDS)


def rows_of(frame) -> list[tuple]:
    columns = ["item_code", "flow", "year", "partner_code", "value", "partner_name", "is_provisional", "n"]
    return sorted(map(tuple, frame.select(columns).collect()), key=str)


def test_merged_parts_equal_the_whole(spark):
    whole = records(spark, 1)
    parts = [C.cell_states(whole.filter(f"seq % 3 = {k}")) for k in range(3)]
    assert rows_of(C.values(C.merge_states(*parts))) == rows_of(C.values(C.cell_states(whole)))


def test_refresh_replaces_due_loads_and_touches_no_other_partition(spark, tmp_path):
    old, new = records(spark, 2), records(spark, 3)
    store = C.CellStore(spark, str(tmp_path), C.cell_states(old).schema)
    assert store.read().count() == 0
    store.refresh(old.select(*C.LOAD), C.cell_states(old))
    assert rows_of(C.values(store.read())) == rows_of(C.values(C.cell_states(old)))
    before = {(r.flow, r.year): r.version for r in store.head()[1]}

    is_due = "year = 2020 and item_code in ('x', 'gone') or year = 2021 and flow = 'import' and item_code = 'y'"
    due = new.filter(is_due).select(*C.LOAD).unionByName(spark.createDataFrame([("gone", "import", 2020)], "item_code string, flow string, year int"))
    written = store.refresh(due, C.cell_states(new.filter(is_due)))
    assert set(written) == {("import", 2020), ("export", 2020), ("import", 2021)}
    mixed = old.filter(f"not ({is_due})").unionByName(new.filter(is_due))
    assert rows_of(C.values(store.read())) == rows_of(C.values(C.cell_states(mixed)))
    after = {(r.flow, r.year): r.version for r in store.head()[1]}
    assert {p for p in after if after[p] != before[p]} == set(written)


def test_a_load_that_became_empty_vanishes(spark, tmp_path):
    old = records(spark, 4).filter("year = 2019")
    store = C.CellStore(spark, str(tmp_path), C.cell_states(old).schema)
    store.refresh(old.select(*C.LOAD), C.cell_states(old))
    store.refresh(old.select(*C.LOAD), C.cell_states(old.limit(0)))
    assert store.read().count() == 0 and store.head()[0] == 2


def test_the_second_of_two_writers_loses_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    old = records(spark, 5)
    first, second = (C.CellStore(spark, str(tmp_path), C.cell_states(old).schema) for _ in range(2))
    first.refresh(old.select(*C.LOAD), C.cell_states(old))
    head = second.head()
    late = old.filter("year = 2019")
    first.refresh(late.select(*C.LOAD), C.cell_states(late.filter("item_code = 'x'")))
    expect = rows_of(C.values(first.read()))
    monkeypatch.setattr(second, "head", lambda: head)  # it has not seen the other commit
    with pytest.raises(C.Conflict):
        second.refresh(late.select(*C.LOAD), C.cell_states(late))
    assert rows_of(C.values(first.read())) == expect


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    old = records(spark, 6)
    store = C.CellStore(spark, str(tmp_path), C.cell_states(old).schema)
    store.refresh(old.select(*C.LOAD), C.cell_states(old))
    expect = rows_of(C.values(store.read()))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(store, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.refresh(old.select(*C.LOAD), C.cell_states(old.limit(5)))
    assert rows_of(C.values(store.read())) == expect
    store.refresh(old.select(*C.LOAD), C.cell_states(old.limit(5)))
    assert len(rows_of(C.values(store.read()))) <= 5

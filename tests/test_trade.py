import pytest
from pyspark.sql import functions as F

from tidemark.operators import trade as T

RECORD = (
    "item_code string, flow string, partner_code string, partner_name string, year int, "
    "value double, is_provisional boolean, seq long"
)
PARTNERS = [("0", "World", True), ("699", "Home", False), ("1", "Ada", False), ("2", "Bel", False), ("3", "Cyr", False)]


def records(spark, rows):
    full = [("010121", "import", c, n, y, v, p, i) for i, (c, n, y, v, p) in enumerate(rows)]
    return spark.createDataFrame(full, RECORD)


def partners(spark):
    return spark.createDataFrame(PARTNERS, "partner_code string, partner_name string, is_aggregate boolean")


def windows(spark, start=2019, end=2023):
    return spark.createDataFrame(
        [("010121", "import", start, end)], "item_code string, flow string, year_start int, year_end int"
    )


def no_issues(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_code string, flow string, year int, reason string")


def table(spark, rows, issues=(), start=2019, end=2023, top_n=10):
    cells = T.partner_cells(records(spark, rows), partners(spark), "699")
    return T.trade_table(cells, windows(spark, start, end), no_issues(spark, issues), top_n).first()


def test_world_and_home_are_stripped_and_listed(spark):
    t = table(spark, [("0", "World", 2020, 9.0, False), ("699", "Home", 2020, 8.0, False), ("1", "Ada", 2020, 1.0, False)])
    assert [r.partner_code for r in t.rows] == ["1"]
    assert t.excluded_partner_codes == ["0", "699"]


def test_unknown_partner_is_kept(spark):
    t = table(spark, [("777", "Unknown partner (777)", 2020, 1.0, False)])
    assert [r.partner_code for r in t.rows] == ["777"]


def test_order_by_total_then_name(spark):
    t = table(spark, [("2", "Bel", 2020, 5.0, False), ("1", "Ada", 2021, 5.0, False), ("3", "Cyr", 2022, 6.0, False)])
    assert [(r.rank, r.partner_name) for r in t.rows] == [(1, "Cyr"), (2, "Ada"), (3, "Bel")]


def test_top_n_without_padding(spark):
    rows = [(str(c), f"P{c:03}", 2020, float(c), False) for c in range(100, 115)]
    t = table(spark, rows)
    assert len(t.rows) == 10 and t.rows[0].cumulative == 114.0
    assert len(table(spark, rows[:3]).rows) == 3


def test_missing_years_stay_null_and_add_nothing(spark):
    t = table(spark, [("1", "Ada", 2019, 2.0, False), ("1", "Ada", 2021, None, False)])
    assert t.rows[0].values_by_year == {2019: 2.0, 2020: None, 2021: None, 2022: None, 2023: None}
    assert t.rows[0].cumulative == 2.0


def test_partner_only_outside_the_window_is_ranked_with_zero(spark):
    t = table(spark, [("1", "Ada", 2010, 9.0, False), ("2", "Bel", 2020, None, False)])
    assert [(r.partner_code, r.cumulative) for r in t.rows] == [("1", 0.0), ("2", 0.0)]


def test_last_record_wins_even_when_null_and_name_is_first(spark):
    rows = [("1", "First", 2015, 1.0, False), ("1", "Ada", 2020, 3.0, False), ("1", "Ada", 2020, None, False), ("1", "Ada", 2021, 1.0, False), ("1", "Later", 2021, 4.0, False)]
    t = table(spark, rows)
    assert t.rows[0].partner_name == "First"
    assert t.rows[0].values_by_year[2020] is None and t.rows[0].values_by_year[2021] == 4.0


def test_year_states_are_disjoint(spark):
    rows = [("1", "Ada", 2019, 1.0, False), ("2", "Bel", 2019, 1.0, False), ("1", "Ada", 2020, 1.0, False), ("2", "Bel", 2020, 1.0, True), ("0", "World", 2021, 1.0, False)]
    t = table(spark, rows, [("010121", "import", 2022, "timeout")])
    assert t.years_finalized == [2019]
    assert t.years_no_data == [2021, 2023]
    assert t.fetch_issue_years == [2022] and t.fetch_issues == ["2022: timeout"]
    assert not set(t.years_finalized) & set(t.years_no_data)


def test_failed_year_with_records_keeps_both_facts(spark):
    t = table(spark, [("1", "Ada", 2022, 1.0, False)], [("010121", "import", 2022, "late"), ("010121", "import", 2020, "early")])
    assert t.years_finalized == [2022]
    assert t.fetch_issues == ["2020: early", "2022: late"]
    assert t.years_no_data == [2019, 2021, 2023]


def test_window_without_records_gives_an_empty_table(spark):
    t = table(spark, [])
    assert t.rows == [] and t.years == [2019, 2020, 2021, 2022, 2023] and t.excluded_partner_codes == []


def test_finality_of_a_load_counts_catch_alls(spark):
    data = records(spark, [("0", "World", 2020, 1.0, True), ("1", "Ada", 2020, 1.0, False)])
    assert T.partition_finality(data).first().is_finalized is False
    cells = T.partner_cells(data, partners(spark), "699")
    status = T.year_status(cells, windows(spark, 2020, 2020), no_issues(spark)).first()
    assert status.is_finalized is True


def test_partition_count_and_order_do_not_matter(spark):
    rows = [(str(c), f"P{c}", y, c * 0.1 + y / 7, c % 2 == 0) for c in range(30, 50) for y in range(2018, 2024)]
    data = records(spark, rows)
    results = []
    for shuffled in (data.repartition(1), data.orderBy(F.rand(3)).repartition(7)):
        cells = T.partner_cells(shuffled, partners(spark), "699")
        results.append(T.trade_table(cells, windows(spark), no_issues(spark)).first().asDict(recursive=True))
    assert results[0] == results[1]


def test_normalize_records(spark):
    raw = spark.createDataFrame(
        [("010121", "import", 4, "2020", None, 7.0, 6.0, True, 1), ("010121", "export", 4, "2021", None, 7.0, 6.0, False, 2), ("010121", "export", 4, "2021", 5.0, 7.0, 6.0, False, 3)],
        "item_code string, flow string, partner_code int, period string, primary_value double, cif_value double, fob_value double, is_reported boolean, seq int",
    )
    got = [tuple(r) for r in T.normalize_records(raw).orderBy("seq").collect()]
    assert got == [
        ("010121", "import", "M", "4", 2020, 7.0, False, 1),
        ("010121", "export", "X", "4", 2021, 6.0, True, 2),
        ("010121", "export", "X", "4", 2021, 5.0, True, 3),
    ]


def test_partner_names_and_placeholder(spark):
    data = spark.createDataFrame([("1",), ("55",)], "partner_code string")
    named = {r.partner_code: r.partner_name for r in T.with_partner_names(data, partners(spark)).collect()}
    assert named == {"1": "Ada", "55": "Unknown partner (55)"}


def test_pivot_dense_and_issue_report(spark):
    data = records(spark, [("1", "Ada", 2020, 2.0, False), ("0", "World", 2021, 5.0, False)])
    cells = T.partner_cells(data, partners(spark), "699")
    assert T.pivot_years(cells, 2020, 2021).first().asDict() == {"item_code": "010121", "flow": "import", "partner_code": "1", "y2020": 2.0, "y2021": None}
    dense = T.dense_years(cells, windows(spark, 2020, 2021)).orderBy("year").collect()
    assert [(r.year, r.value) for r in dense] == [(2020, 2.0), (2021, None)]
    expected = spark.createDataFrame([("010121", "import", y) for y in (2020, 2021, 2022)], "item_code string, flow string, year int")
    manifest = no_issues(spark, [("010121", "import", 2020, None), ("010121", "import", 2021, "bad")])
    got = T.fetch_issues(expected, manifest).orderBy("year").collect()
    assert [(r.year, r.reason) for r in got] == [(2021, "bad"), (2022, "no load recorded")]


@pytest.mark.parametrize("value, text", [(2.5, "2"), (3.5, "4"), (1234567.4, "1,234,567")])
def test_rendered_block(spark, value, text):
    rows = [("1", "Ada", 2020, value, False), ("0", "World", 2020, 1.0, False)]
    cells = T.partner_cells(records(spark, rows), partners(spark), "699")
    tables = T.trade_table(cells, windows(spark, 2020, 2021), no_issues(spark))
    block = tables.select(T.render_block(F.lit("IMPORTS")).alias("b")).first().b
    assert block.split("\n") == [
        "IMPORTS (USD, top 1 partner countries):",
        f"  #1 Ada — 2yr cumulative {text} USD | by year: 2020: {text}, 2021: no data",
        "  (excluded aggregate/unspecified-partner codes, not shown above: 0)",
        "  (provisional / not yet finalized years — subject to revision: 2021)",
    ]


def test_rendered_empty_block(spark):
    cells = T.partner_cells(records(spark, []), partners(spark), "699")
    tables = T.trade_table(cells, windows(spark, 2020, 2020), no_issues(spark))
    block = tables.select(T.render_block(F.lit("EXPORTS")).alias("b")).first().b
    assert "  (no partner-country data available)" in block.split("\n")


def test_nested_tables_stay_where_they_are_made(spark):
    """No part is dealt out by its window, only by its item; several windows and flows find their own parts."""
    cells = T.partner_cells(
        records(spark, [("1", "Ada", 2020, 5.0, False), ("2", "Bo", 2022, 7.0, True), ("0", "World", 2020, 9.0, False)]),
        partners(spark),
        "699",
    )
    asked = spark.createDataFrame(
        [("010121", "import", 2019, 2020), ("010121", "import", 2021, 2022), ("010121", "export", 2019, 2020), ("020202", "import", 2019, 2019)],
        "item_code string, flow string, year_start int, year_end int",
    )
    tables = T.trade_table(cells, asked, no_issues(spark, [("010121", "import", 2019, "timeout")]))
    sizes = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(sizes)
    spark.conf.set(sizes, "-1")
    try:
        plan = tables._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(sizes, before)
    moves = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moves and not any("year_start" in x for x in moves)
    got = {(r.item_code, r.flow, r.year_start): r for r in tables.collect()}
    assert len(got) == 4
    first, second = got["010121", "import", 2019], got["010121", "import", 2021]
    assert [(r.partner_code, r.cumulative) for r in first.rows] == [("1", 5.0), ("2", 0.0)]
    assert [(r.partner_code, r.cumulative) for r in second.rows] == [("2", 7.0), ("1", 0.0)]
    assert first.years_finalized == [2020] and first.fetch_issues == ["2019: timeout"] and first.years_no_data == []
    assert second.years_finalized == [] and second.fetch_issues == [] and second.years_no_data == [2021]
    export, other = got["010121", "export", 2019], got["020202", "import", 2019]
    assert export.rows == [] and export.years_no_data == [2019, 2020] and export.excluded_partner_codes == []
    assert first.excluded_partner_codes == ["0"] and other.rows == [] and other.years_no_data == [2019]

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import requests as R
from tidemark.operators import taxonomy as X

AS_OF = "2024-06-01 00:00:00"


def judge(spark, bodies):
    raw = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(raw, "request_id int, raw string")
    rows = R.validate_requests(frame, AS_OF).orderBy("request_id").collect()
    return [r.reasons for r in rows]


def body(**fields):
    return {"hs_code": "010121", **fields}


@pytest.fixture(scope="module")
def verdicts(spark):
    cases = [
        (body(), []),
        (body(hs_code="10121"), ["BAD_CODE"]),
        (body(hs_code="01012a"), ["BAD_CODE"]),
        ({"flow": "both"}, ["BAD_CODE"]),
        (body(flow="sideways"), ["BAD_FLOW"]),
        (body(value_or_volume="weight"), ["BAD_MEASURE"]),
        (body(year_start=1962, year_end=1981), []),
        (body(year_start=1961, year_end=1970), ["YEAR_TOO_EARLY"]),
        (body(year_end=2025), []),
        (body(year_end=2026), ["YEAR_TOO_LATE"]),
        (body(year_start=2020, year_end=2019), ["YEAR_ORDER"]),
        (body(year_start=2000, year_end=2019), []),
        (body(year_start=2000, year_end=2020), ["YEAR_SPAN"]),
        (body(year_start="soon"), ["BAD_YEAR"]),
        (body(year_start=None, year_end=None), []),
        (body(colour="red"), ["UNKNOWN_FIELD"]),
        (body(tenant_id="x" * 128), []),
        (body(tenant_id="x" * 129), ["TEXT_TOO_LONG"]),
        (body(partner_region="EU"), ["RESERVED_FILTER"]),
        (body(value_or_volume="volume"), ["RESERVED_FILTER"]),
        ('{"hs_code": ', ["MALFORMED_JSON", "BAD_CODE"]),
        ('{"hs_code": "010121"} trailing', ["MALFORMED_JSON", "BAD_CODE"]),
        ('["010121"]', ["MALFORMED_JSON", "BAD_CODE"]),
        ('{"hs_code": 123456}', ["BAD_TYPE"]),
        ('{"hs_code": "010121", "flow": null}', ["BAD_TYPE"]),
        ('{"hs_code": "010121", "partner_region": null, "year_start": null}', []),
        ('{"hs_code": "010121\\n"}', ["BAD_CODE"]),
        (body(user_id="y" * 70_000), ["REQUEST_TOO_LARGE", "TEXT_TOO_LONG"]),
    ]
    return [(b, want, got) for (b, want), got in zip(cases, judge(spark, [b for b, _ in cases]))]


def test_validation_reasons(verdicts):
    for request, want, got in verdicts:
        assert got == want, str(request)[:100]


def test_windows_default_and_are_checked_again(spark):
    raw = [(1, json.dumps(body())), (2, json.dumps(body(year_start=1962))), (3, json.dumps(body(year_end=2010))), (4, json.dumps(body(hs_code="999999"))), (5, json.dumps(body(flow="up")))]
    frame = spark.createDataFrame(raw, "request_id int, raw string")
    tree = spark.createDataFrame([("010121", "x", "I", "0101", "6"), ("999999", "y", "I", "", "4")], "code string, description string, section string, parent string, level string")
    got = {r.request_id: (r.year_start, r.year_end, r.error_code) for r in R.admit_requests(frame, tree, AS_OF).collect()}
    assert got[1] == (2019, 2023, None)
    assert got[2] == (1962, 2023, "YEAR_SPAN")
    assert got[3] == (2006, 2010, None)
    assert got[4][2] == "INVALID_HS_CODE"
    assert got[5][2] == "BAD_FLOW"


def test_search_text_bounds(spark):
    frame = spark.createDataFrame([(0, ""), (1, "a"), (2, "é" * 200), (3, "b" * 201), (4, None)], "query_id int, query_text string")
    got = {r.query_id: r.error_code for r in R.validate_search(frame).collect()}
    assert got == {0: "EMPTY_TEXT", 1: None, 2: None, 3: "TEXT_TOO_LONG", 4: "EMPTY_TEXT"}


def test_fingerprints_do_not_collide(spark):
    rows = [("both", None, "value"), ("both", "", "value"), ("both", "a|5:value", "value"), ("both", "a", "5:value"), ("import", None, "value")]
    frame = spark.createDataFrame(rows, "flow string, partner_region string, value_or_volume string")
    prints = [r.f for r in frame.select(R.request_fingerprint().alias("f")).collect()]
    assert len(set(prints)) == len(rows)


def test_equal_requests_are_computed_once(spark):
    frame = spark.createDataFrame([(i, "hot" if i else "cold") for i in range(9)], "id int, k string")
    seen = []

    def compute(keys):
        seen.append(keys.count())
        return keys.withColumn("size", F.length("k"))

    got = R.coalesce_requests(frame, ["k"], compute).collect()
    assert seen == [2] and {(r.id, r.size) for r in got} == {(i, 3 if i else 4) for i in range(9)}


TREE = [
    ("01", "animals", "I", "TOTAL", "2"),
    ("0101", "horses", "I", "01", "4"),
    ("010121", "pure-bred horses", "I", "0101", "6"),
    ("020202", "orphan", "IX", "0202", "6"),
    ("A", "loop a", "I", "B", "4"),
    ("B", "loop b", "I", "A", "4"),
    ("030303", "in a loop", "II", "A", "6"),
    ("040404", "own parent", "I", "040404", "6"),
]


def tree(spark):
    return spark.createDataFrame(TREE, "code string, description string, section string, parent string, level string")


def test_ancestors_stop_at_gaps_and_cycles(spark):
    got = {r.code: [p.code for p in r.path] for r in X.ancestors(tree(spark)).collect()}
    assert got["010121"] == ["0101", "01"]
    assert got["020202"] == [] and got["040404"] == []
    assert got["030303"] == ["A", "B"]
    assert got["A"] == ["B"]


def test_deep_trees_and_long_cycles(spark):
    chain = [(str(i), "d", "s", str(i + 1), "4") for i in range(12)]
    loop = [(f"L{i}", "d", "s", f"L{(i + 1) % 9}", "4") for i in range(9)] + [("in", "d", "s", "L3", "6")]
    frame = spark.createDataFrame(chain + loop, "code string, description string, section string, parent string, level string")
    got = {r.code: [p.code for p in r.path] for r in X.ancestors(frame).collect()}
    assert got["0"] == [str(i) for i in range(1, 12)] and got["11"] == []
    assert got["in"] == [f"L{(3 + i) % 9}" for i in range(9)]
    assert got["L0"] == [f"L{i}" for i in range(1, 9)]


def test_taxonomy_text(spark):
    sections = spark.createDataFrame([("I", "live animals; Products"), ("II", "")], "section string, name string")
    got = {r.code: r.taxonomy_text for r in X.taxonomy_text(tree(spark), sections).collect()}
    assert got["010121"] == "HS 010121: pure-bred horses\nParent headings: animals > horses\nHS Section I: Live animals; Products"
    assert got["020202"] == "HS 020202: orphan"
    assert set(got) == {"010121", "020202", "030303", "040404"}


def test_last_entry_wins_and_lookup_keeps_unknown(spark):
    rows = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "code string, description string, seq int")
    latest = X.latest_entries(rows, "seq")
    keys = spark.createDataFrame([("1",), ("2",)], "code string")
    assert {(r.code, r.description) for r in X.lookup(keys, latest).collect()} == {("1", "new"), ("2", None)}


def test_texts_are_parsed_once_behind_a_filter(spark):
    """A filter on the reasons does not put the parsers in place of every use of their result."""
    frame = spark.createDataFrame([(1, json.dumps(body())), (2, "{"), (3, None)], "request_id int, raw string")
    valid = R.resolve_windows(R.validate_requests(frame, AS_OF).filter("size(reasons) = 0"), AS_OF)
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and plan.count("parseJson") == 1
    assert [(r.request_id, r.year_start, r.year_end) for r in valid.collect()] == [(1, 2019, 2023)]

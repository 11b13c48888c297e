import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import analysis as A

AS_OF = "2024-06-01 00:00:00"
RECORD = (
    "item_code string, flow string, partner_code string, partner_name string, year int, "
    "value double, is_provisional boolean, seq long"
)


@pytest.fixture(scope="module")
def inputs(spark):
    bodies = [
        {"hs_code": "010121", "year_start": 2019, "year_end": 2023, "user_id": "ann"},
        {"hs_code": "010121", "user_id": "bob"},
        {"hs_code": "010121", "flow": "import"},
        {"hs_code": "010129", "flow": "export"},
        {"hs_code": "555555"},
        {"hs_code": "bad"},
    ]
    requests = spark.createDataFrame(
        [(i, json.dumps(b)) for i, b in enumerate(bodies)], "request_id int, raw string"
    )
    taxonomy = spark.createDataFrame(
        [("01", "animals", "I", "", "2"), ("010121", "horses", "I", "01", "6"), ("010129", "other horses", "I", "01", "6")],
        "code string, description string, section string, parent string, level string",
    )
    sections = spark.createDataFrame([("I", "live animals")], "section string, name string")
    records = spark.createDataFrame(
        [("010121", "import", "1", "Ada", 2020, 5.4, False, 1), ("010121", "export", "1", "Ada", 2021, 7.6, False, 2), ("010121", "import", "0", "World", 2020, 9.0, False, 3)],
        RECORD,
    )
    partners = spark.createDataFrame([("0", "World", True), ("1", "Ada", False)], "partner_code string, partner_name string, is_aggregate boolean")
    issues = spark.createDataFrame([("010121", "export", 2023, "timeout")], "item_code string, flow string, year int, reason string")
    return requests, taxonomy, sections, records, partners, issues


def analyse(inputs, **writers):
    frame = A.trade_analysis(*inputs, reporter="699", as_of=AS_OF, **writers)
    return {r.request_id: r for r in frame.collect()}


def test_analysis_of_many_requests(inputs):
    got = analyse(inputs)
    assert len(got) == 6
    first = got[0]
    assert first.error_code is None and first.user_id == "ann" and got[1].user_id == "bob"
    assert first.imports == got[1].imports and first.fingerprint == got[1].fingerprint
    assert [(r.partner_code, r.cumulative) for r in first.imports.rows] == [("1", 5.4)]
    assert first.imports.excluded_partner_codes == ["0"]
    assert first.exports.fetch_issues == ["2023: timeout"] and 2023 not in first.exports.years_no_data
    assert first.analytical_summary == (
        "HS code 010121. Imports over 5 years in USD: rank 1 5. Exports over 5 years in USD: rank 1 8."
    )
    assert "horses" in first.item_description and not any(c.isdigit() for c in first.item_description)
    assert got[2].exports is None and got[2].imports is not None
    assert got[3].exports.rows == [] and got[3].exports.years_no_data == [2019, 2020, 2021, 2022, 2023]
    assert got[4].error_code == "INVALID_HS_CODE" and got[5].error_code == "BAD_CODE"
    assert got[4].imports is None


def test_an_invented_number_voids_the_summary(inputs):
    def invent(analyses):
        return A.default_summary(analyses).withColumn(
            "analytical_summary", F.concat("analytical_summary", F.lit(" Up 99 USD."))
        )

    got = analyse(inputs, summarize=invent)
    assert got[0].error_code == "UNGROUNDED_SUMMARY" and got[0].offending == [99.0]
    assert got[0].imports is None and got[0].analytical_summary is None
    assert got[5].error_code == "BAD_CODE"


def test_a_flow_not_asked_for_backs_no_number(inputs):
    def other_flow(analyses):
        return analyses.withColumn("analytical_summary", F.lit("Exports: 8 USD."))

    got = analyse(inputs, summarize=other_flow)
    assert got[0].error_code is None and got[2].error_code == "UNGROUNDED_SUMMARY"


def test_descriptions_hold_no_number_and_must_exist(inputs):
    def number(items):
        return items.withColumn("item_description", F.lit("made in 2020"))

    def nothing(items):
        return items.withColumn("item_description", F.lit(None).cast("string"))

    assert analyse(inputs, describe=number)[0].error_code == "UNGROUNDED_DESCRIPTION"
    assert analyse(inputs, describe=nothing)[0].error_code == "INCOMPLETE_STATE"


def test_documents_are_written(spark, inputs, tmp_path):
    frame = A.trade_analysis(*inputs, reporter="699", as_of=AS_OF)
    provenance = {"source": "test", "reporter_country": "Home", "prompt_version": "v1"}
    A.write_documents(A.analysis_document(frame, provenance, AS_OF), str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 4
    one = next(x for x in lines if x["request_id"] == 0)
    assert one["provenance"] == {
        "currency": "USD",
        "period_type": "calendar_year",
        "prompt_version": "v1",
        "reporter_country": "Home",
        "source": "test",
        "retrieved_at": one["provenance"]["retrieved_at"],
    }
    assert one["imports"]["rows"][0]["values_by_year"]["2020"] == 5.4


def test_tables_are_the_same_from_many_tasks(spark, inputs, monkeypatch):
    few = analyse(inputs)
    parts = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    monkeypatch.setattr(A, "CELLS_A_TASK", 1)
    spark.conf.set(parts, "2")
    try:
        assert analyse(inputs) == few
    finally:
        spark.conf.set(parts, before)

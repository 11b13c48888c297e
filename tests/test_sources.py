import json

from tidemark.operators import trade as T
from tidemark.operators.grounding import ruleset_integrity
from tidemark.sources import dimensions as D
from tidemark.sources import envelopes as E

ROW = {
    "reporterCode": 699,
    "partnerCode": 12,
    "period": "2022",
    "cmdCode": "010121",
    "flowCode": "M",
    "primaryValue": 10.5,
    "cifvalue": None,
    "fobvalue": None,
    "isReported": True,
    "isAggregate": False,
    "somethingElse": 1,
}


def envelope(*rows, **extra):
    return {"elapsedTime": "0.1", "count": len(rows), "error": "", "data": list(rows), **extra}


FILES = {
    ("010121", "import", 2019): envelope(ROW, {**ROW, "partnerCode": 0, "isReported": False}),
    ("010121", "import", 2020): envelope(),
    ("010121", "import", 2021): envelope(ROW, {**ROW, "partnerCode": "many"}),
    ("010121", "import", 2022): envelope({k: v for k, v in ROW.items() if k != "isReported"}),
    ("010121", "import", 2023): envelope(error="quota used up"),
    ("010121", "export", 2019): "{not json",
    ("010121", "export", 2020): envelope({**ROW, "primaryValue": None, "fobvalue": 3.0}, count=258),
    ("010121", "export", 2021): {"data": [ROW], "error": ""},
    ("010121", "export", 2022): envelope({**ROW, "period": "soon"}),
}


def write_files(root):
    for (item, flow, year), content in FILES.items():
        folder = root / f"item_code={item}" / f"flow={flow}" / f"year={year}"
        folder.mkdir(parents=True)
        text = content if isinstance(content, str) else json.dumps(content, indent=1)
        (folder / "part.json").write_text(text, encoding="utf-8")
    return str(root)


def test_envelopes(spark, tmp_path):
    loaded = E.read_envelopes(spark, write_files(tmp_path)).cache()
    reasons = {(r.item_code, r.flow, r.year): r.reason for r in E.envelope_manifest(loaded).collect()}
    schema, broken = "not an envelope", "no JSON"
    assert reasons == {
        ("010121", "import", 2019): None,
        ("010121", "import", 2020): None,
        ("010121", "import", 2021): schema,
        ("010121", "import", 2022): schema,
        ("010121", "import", 2023): "the source says: quota used up",
        ("010121", "export", 2019): broken,
        ("010121", "export", 2020): None,
        ("010121", "export", 2021): schema,
        ("010121", "export", 2022): schema,
    }
    records = T.normalize_records(E.envelope_records(loaded))
    got = {(r.item_code, r.flow, r.partner_code, r.year, r.value, r.is_provisional) for r in records.collect()}
    assert got == {
        ("010121", "import", "12", 2022, 10.5, False),
        ("010121", "import", "0", 2022, 10.5, True),
        ("010121", "export", "12", 2022, 3.0, False),
    }
    expected = spark.createDataFrame(
        [("010121", "import", y) for y in (2018, 2019, 2023)], "item_code string, flow string, year int"
    )
    assert E.request_parameters(expected).first().flow_code == "M"
    issues = {r.year: r.reason for r in T.fetch_issues(expected, E.envelope_manifest(loaded)).collect()}
    assert issues == {2018: "no load recorded", 2023: "the source says: quota used up"}


def test_records_are_stored_by_flow_and_year(spark, tmp_path):
    records = T.normalize_records(E.envelope_records(E.read_envelopes(spark, write_files(tmp_path / "in"))))
    E.write_records(records.drop("seq"), str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out")).filter("flow = 'export' AND year = 2022")
    assert stored.count() == 1
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flow" in plan


def test_dimension_files(spark, tmp_path):
    partners = tmp_path / "partners.csv"
    partners.write_text('partner_code,partner_desc,is_aggregate_code\n0,World, TRUE \n012,"Ada, Republic of",false\n', encoding="utf-8")
    got = {r.partner_code: (r.partner_name, r.is_aggregate) for r in D.read_partners(spark, str(partners)).collect()}
    assert got == {"0": ("World", True), "012": ("Ada, Republic of", False)}

    taxonomy = tmp_path / "taxonomy.csv"
    taxonomy.write_text("section,hscode,description,parent,level\nI,010121,old,0101,6\nI,0101,horses,01,4\nI,010121,new,0101,6\n", encoding="utf-8")
    got = {r.code: r.description for r in D.read_taxonomy(spark, str(taxonomy)).collect()}
    assert got == {"010121": "new", "0101": "horses"}

    sections = tmp_path / "sections.csv"
    sections.write_text("section,name\nI,live animals\n", encoding="utf-8")
    assert D.read_sections(spark, str(sections)).first().name == "live animals"


def test_rule_files(spark, tmp_path):
    good = {"hs_code": "010121", "section": "I", "section_name": "x", "description_must_reference": ["horse"], "description_must_not_contain": []}
    short = {k: v for k, v in good.items() if k != "section"}
    path = tmp_path / "rules.jsonl"
    path.write_text("\n".join([json.dumps(good), "", "   ", json.dumps(short)]) + "\n", encoding="utf-8")
    rows = D.read_rules(spark, str(path)).collect()
    assert [r.missing_fields for r in rows] == [[], ["section"]]
    leaves = spark.createDataFrame([("010121",)], "code string")
    sound = ruleset_integrity(D.read_rules(spark, str(path)).filter("size(missing_fields) = 0"), leaves, 1).first()
    assert sound.is_sound


def test_csv_quotes_line_breaks_and_column_order(spark, tmp_path):
    path = tmp_path / "taxonomy.csv"
    path.write_text('level,hscode,description,parent,section\n6,730410,"tubes of 2"" bore, steel",7304,XV\n4,7304,"pipes,\nhollow",73,XV\n')
    got = {r.code: (r.description, r.parent, r.section, r.level) for r in D.read_taxonomy(spark, str(path)).collect()}
    assert got == {"730410": ('tubes of 2" bore, steel', "7304", "XV", "6"), "7304": ("pipes,\nhollow", "73", "XV", "4")}


def test_rule_file_to_gate(spark, tmp_path):
    from tidemark.operators.grounding import rule_gate

    path = tmp_path / "rules.jsonl"
    path.write_text('{"hs_code": "010121", "section": "I"}\n')
    texts = spark.createDataFrame([("010121", "horses")], "code string, text string")
    scanned = spark.createDataFrame([], "code string, scan array<struct<value:double,grounded:boolean>>")
    findings = rule_gate(D.read_rules(spark, str(path)), texts, scanned, texts.select("code"), 1).collect()
    assert [r.rule for r in findings] == ["missing_field"] and "section_name" in findings[0].detail

import random

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import grounding as G

FACTS = {2019.0, 2020.0, 2023.0, 1234567.0, 42.0, 10121.0, -3.0}
STRUCTURAL = {1.0, 2.0, 3.0, 5.0, 10.0}

TEXTS = [
    "Imports were 1,234,567 USD in 2019-2023.",
    "They grew by 42, then rose 42% and 42 percent, 42 points, 42pp, 42 pct.",
    "The top 3 partners, #2, rank 1, ranked 2, no. 5 and 9.",
    "Over 5 years, 10 partners; 5-year plan, 5 - years, 10 countries.",
    "Bare 3 and bare 5.",
    "HS code 010121 fell by\t42. Fell by 42!",
    "12,34 and 1,2345 and 1.2.3 and -3 and 7-3 and --3",
    "no numbers here, only café and naïve words",
    "",
    "42",
    "stop 3 desktop 3 #3 Top\n3 TOP 3 topped 3",
    "2019,2020, 2023.  1,234,566.6 1,234,567.4",
    "points5 points-5 42points 42 pointless 42 pp2",
    "grew by5 grew by -3 grew  by 42 regrew by 42 5grew by 42",
    "2.5 and 3.5 years, 4.5 years",
]

# Verdicts by hand: each number, marked "!" where no fact backs it.
VERDICTS = [
    "1234567 2019 2023",
    "42! 42! 42! 42! 42! 42!",
    "3 2 1 2 5 9!",
    "5 10 5 5 10",
    "3! 5!",
    "10121 42! 42!",
    "12! 34! 1234! 1.2! 3! -3 7! 3! -3",
    "",
    "",
    "42",
    "3! 3! 3 3 3 3!",
    "2019 2020 2023 1234566.6 1234567.4",
    "5! -5! 42! 42 42 2!",
    "5! -3! 42! 42 5! 42",
    "2.5! 3.5! 4.5!",
]


def scan(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    facts = F.array(*[F.lit(x) for x in sorted(FACTS)])
    structural = F.array(*[F.lit(x) for x in sorted(STRUCTURAL)])
    rows = frame.select("id", G.scan_numbers(F.col("text"), facts, structural).alias("s")).collect()
    return [[(n.value, n.grounded) for n in r.s] for r in sorted(rows, key=lambda r: r.id)]


def test_scan_of_known_sentences(spark):
    for text, verdict, got in zip(TEXTS, VERDICTS, scan(spark, TEXTS)):
        want = [(float(v.rstrip("!")), not v.endswith("!")) for v in verdict.split()]
        assert got == want, text


def random_words(rng, n):
    return [rng.choice(["imports", "café", "top", "years", "rose", "no.", "x"]) for _ in range(n)]


def test_scan_properties_on_random_texts(spark):
    """Order is kept; a percent sign voids a fact; a context word backs a rank and its loss voids it."""
    rng = random.Random(11)
    facts = [rng.choice(["42", "2019", "1,234,567"]) for _ in range(200)]
    plain = [f"of {a} or {b} {' '.join(random_words(rng, 3))}" for a, b in zip(facts, facts[1:])]
    for a, b, got in zip(facts, facts[1:], scan(spark, plain)):
        assert got == [(float(x.replace(",", "")), True) for x in (a, b)]
    voided = scan(spark, [f"of {a}{gap}% or {b}" for a, b in zip(facts, facts[1:]) for gap in ("", " ")])
    assert all([g for _, g in got] == [False, True] for got in voided)
    ranks = [rng.choice(["2", "3", "5"]) for _ in range(200)]
    assert all(got == [(float(r), True)] for r, got in zip(ranks, scan(spark, [f"the top {r} of all" for r in ranks])))
    assert all(got == [(float(r), False)] for r, got in zip(ranks, scan(spark, [f"the {r} of all" for r in ranks])))


def test_facts_of_tables(spark):
    row = "array<struct<rank:int,partner_name:string,partner_code:string,values_by_year:map<int,double>,cumulative:double>>"
    tables = spark.createDataFrame(
        [("010121", [2019, 2020], [(1, "a", "1", {2019: 2.5, 2020: None}, 2.5)]), ("010121", [2019, 2020], [(1, "b", "2", {2019: 7.0, 2020: 8.5}, 15.5)])],
        f"item_code string, years array<int>, rows {row}",
    )
    facts = G.table_facts(tables).first()
    assert set(facts.facts) == {2019.0, 2020.0, 2.0, 7.0, 8.0, 16.0, 10121.0}
    assert set(facts.structural) == {1.0, 2.0}


def test_gate_lists_offenders_in_order(spark):
    texts = spark.createDataFrame([(1, "i", "2019 then 8% of 9"), (2, "i", "words"), (3, "none", "2019")], "doc_id int, item_code string, text string")
    facts = spark.createDataFrame([("i", [2019.0], [1.0])], "item_code string, facts array<double>, structural array<double>")
    got = {r.doc_id: (r.error_code, r.offending) for r in G.gate_texts(G.ground_texts(texts, facts)).collect()}
    assert got == {1: ("UNGROUNDED_SUMMARY", [8.0, 9.0]), 2: (None, []), 3: ("UNGROUNDED_SUMMARY", [2019.0])}


def test_text_functions(spark):
    frame = spark.createDataFrame([("Le café_3 coûte 12,50 € (code 123456, 123456 et 654321) x1234567",)], "t string")
    row = frame.select(
        X.tokens(F.col("t")).alias("tokens"),
        X.strip_numeric_tokens(F.col("t")).alias("plain"),
        X.codes(F.col("t")).alias("codes"),
        X.codes(F.col("t"), 1).alias("one"),
        X.numbers(F.col("t")).alias("numbers"),
        X.missing_phrases(F.col("t"), F.array(F.lit("CAFÉ"), F.lit("tea"))).alias("missing"),
        X.present_phrases(F.col("t"), F.array(F.lit("CAFÉ"), F.lit("tea"))).alias("present"),
    ).first()
    assert row.tokens == ["le", "café_3", "coûte", "12", "50", "code", "123456", "123456", "et", "654321", "x1234567"]
    assert row.plain == "Le coûte € (code et"
    assert row.codes == ["123456", "654321"] and row.one == ["123456"]
    assert row.numbers == [3.0, 12.0, 50.0, 123456.0, 123456.0, 654321.0, 1234567.0]
    assert row.missing == ["tea"] and row.present == ["CAFÉ"]


def test_rule_gate(spark):
    rules = spark.createDataFrame([("a", "I", ["horse"], ["cow"]), ("zz", "II", [], [])], "code string, section string, must array<string>, must_not array<string>")
    texts = spark.createDataFrame([("a", "A Cow")], "code string, text string")
    leaves = spark.createDataFrame([("a",)], "code string")
    scanned = spark.createDataFrame([("a", [(1.0, False)]), ("other", [(1.0, False)])], "code string, scan array<struct<value:double,grounded:boolean>>")
    findings = G.rule_gate(rules, texts, scanned, leaves, 3)
    assert {tuple(r) for r in findings.collect()} == {
        ("blocking", "unknown_code", "zz", ""),
        ("blocking", "few_sections", "*", "2"),
    }
    known = rules.where("code = 'a'")
    findings = G.rule_gate(known, texts, scanned, leaves, 1)
    assert {tuple(r) for r in findings.collect()} == {
        ("blocking", "ungrounded_number", "a", "1"),
        ("warn", "missing_phrase", "a", "horse"),
        ("warn", "forbidden_phrase", "a", "cow"),
    }
    verdict = G.gate_verdict(findings).first()
    assert (verdict.n_blocking, verdict.n_warnings, verdict.passed) == (1, 2, False)
    absent = known.withColumn("missing_fields", F.array(F.lit("section")))
    assert [tuple(r) for r in G.rule_gate(absent, texts, scanned, leaves, 1).collect()] == [
        ("blocking", "missing_field", "a", "section")
    ]
    sound = G.ruleset_integrity(rules, leaves, 2).first()
    assert (sound.n_unknown, sound.n_sections, sound.is_sound) == (1, 2, False)

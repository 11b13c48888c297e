"""Checks that every number or phrase of a text is backed by the underlying tables.

Everything here is column expressions: a text is split at its numbers into gaps, and number i is
judged by its value and by the gaps on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..functions.text import NUMBER, as_number, missing_phrases, numbers, present_phrases

# Contexts of a number.  The flags make matching case-insensitive and Unicode-aware.
_DERIVED_AFTER = r"(?iU)^\s*(?:%|percent\b|pct\.?|points?\b|pp\b)"
_DERIVED_BEFORE = r"(?iU)\b(?:grew|declined|increased|decreased|rose|fell)\s+by\s*$"
_STRUCTURAL_BEFORE = r"(?iU)(?:#|\btop\b|\brank(?:s|ed|ing)?\b|\bno\.)\s*$"
_STRUCTURAL_AFTER = r"(?iU)^[\s-]*(?:years?|partners?|countries)\b"

MIN_SECTIONS = 10


def fact_numbers(years: Column, rows: Column) -> Column:
    """Numbers a table backs as values: its years, rounded cells and rounded totals."""
    cells = F.flatten(
        F.transform(
            rows,
            lambda r: F.concat(
                F.filter(F.map_values(r["values_by_year"]), lambda v: v.isNotNull()),
                F.array(r["cumulative"]),
            ),
        )
    )
    return F.array_distinct(
        F.concat(years.cast("array<double>"), F.transform(cells, half_even))
    )


def structural_numbers(years: Column, rows: Column) -> Column:
    """Numbers true by construction: number of years, number of rows, and the ranks."""
    counts = F.array(F.size(years), F.size(rows))
    return F.array_distinct(F.concat(counts, F.transform(rows, lambda r: r["rank"]))).cast(
        "array<double>"
    )


def code_number(code: Column) -> Column:
    """The item code read as a number, as an array of at most one."""
    return F.array_compact(F.array(half_even(code.try_cast("double"))))


def table_facts(tables: DataFrame) -> DataFrame:
    """Per item: the numbers a text about any of its tables may state.

    ``facts`` count anywhere, ``structural`` only in a fitting context.  Both arrays are limited by
    the size of a table (top rows times years), not by the data.
    """
    years, rows = F.col("years"), F.col("rows")
    grouped = (
        tables.select(
            "item_code",
            fact_numbers(years, rows).alias("facts"),
            structural_numbers(years, rows).alias("structural"),
        )
        .groupBy("item_code")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("facts"))).alias("facts"),
            F.array_distinct(F.flatten(F.collect_list("structural"))).alias("structural"),
        )
    )
    return grouped.withColumn("facts", F.array_union("facts", code_number(F.col("item_code"))))


def scan_numbers(text: Column, facts: Column, structural: Column) -> Column:
    """array<struct<value, grounded>> of every number of ``text``, in order.

    A gap that touches a number gets that neighbour's character back at its edge, so that word
    boundaries behave as in the whole text.  The inputs are bound once per text in a one-element
    array: expressions used inside a lambda would be evaluated again for every number.
    """
    bound = F.array(
        F.struct(
            F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)).alias("found"),
            F.split(text, NUMBER, -1).alias("gaps"),
            facts.alias("facts"),
            structural.alias("structural"),
        )
    )

    def judge(b: Column, token: Column, i: Column) -> Column:
        rounded = half_even(as_number(token))
        before = F.concat(F.when(i > 0, F.lit("0")).otherwise(F.lit("")), F.get(b["gaps"], i))
        touching = F.substring(F.get(b["found"], i + 1), 1, 1)
        after = F.concat(F.get(b["gaps"], i + 1), F.coalesce(touching, F.lit("")))
        derived = after.rlike(_DERIVED_AFTER) | before.rlike(_DERIVED_BEFORE)
        fitting = before.rlike(_STRUCTURAL_BEFORE) | after.rlike(_STRUCTURAL_AFTER)
        # Set membership comes first: it is cheap and rules most numbers out before any pattern.
        backed = F.array_contains(b["facts"], rounded) | (
            F.array_contains(b["structural"], rounded) & fitting
        )
        grounded = F.coalesce(backed & ~derived, F.lit(False))
        return F.struct(as_number(token).alias("value"), grounded.alias("grounded"))

    scans = F.transform(
        bound, lambda b: F.transform(b["found"], lambda token, i: judge(b, token, i))
    )
    return F.element_at(scans, 1)


def ground_texts(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """Texts (doc_id, item_code, text) with ``scan``; an item without tables backs no number.

    The facts side has one short row per item; a hot item is a hot key of the text side only, and
    the join is broadcast when the facts are small or split by adaptive execution when not.
    """
    none = F.array().cast("array<double>")
    return texts.join(facts, "item_code", "left").select(
        *texts.columns,
        scan_numbers(
            F.col("text"), F.coalesce("facts", none), F.coalesce("structural", none)
        ).alias("scan"),
    )


def offending(scan: Column) -> Column:
    """Ungrounded numbers in order of appearance."""
    return F.transform(F.filter(scan, lambda x: ~x["grounded"]), lambda x: x["value"])


def passes(scan: Column) -> Column:
    """All numbers grounded; a text without numbers passes."""
    return F.forall(scan, lambda x: x["grounded"])


def gate_texts(scanned: DataFrame) -> DataFrame:
    """Scanned texts with ``error_code`` UNGROUNDED_SUMMARY and the offenders when they fail."""
    return scanned.withColumn(
        "error_code", F.when(~passes(F.col("scan")), F.lit("UNGROUNDED_SUMMARY"))
    ).withColumn("offending", offending(F.col("scan")))


def number_free(texts: DataFrame) -> DataFrame:
    """Texts with ``is_number_free``."""
    return texts.withColumn("is_number_free", F.size(numbers(F.col("text"))) == 0)


def check_phrases(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Phrase rules (code, must, must_not) against the text of their code.

    Returns one row per rule with the phrases missing and the forbidden phrases present.
    """
    return rules.join(texts, "code", "left").select(
        *rules.columns,
        missing_phrases(F.coalesce("text", F.lit("")), F.col("must")).alias("missing"),
        present_phrases(F.coalesce("text", F.lit("")), F.col("must_not")).alias("forbidden"),
    )


def ruleset_integrity(rules: DataFrame, leaves: DataFrame, min_sections: int = MIN_SECTIONS) -> DataFrame:
    """One row: rules with unknown codes, distinct sections, and whether the set is sound."""
    known = leaves.select("code").distinct().withColumn("_known", F.lit(True))
    return rules.join(known, "code", "left").agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.count_if(F.col("_known").isNull()).alias("n_unknown"),
        F.count_distinct("section").alias("n_sections"),
    ).withColumn(
        "is_sound", (F.col("n_unknown") == 0) & (F.col("n_sections") >= min_sections)
    )


def rule_gate(
    rules: DataFrame, texts: DataFrame, scanned: DataFrame, leaves: DataFrame, min_sections: int
) -> DataFrame:
    """Findings (severity, rule, code, detail) of a rule set.

    Absent fields, unknown codes and too few sections break the integrity of the set; then nothing
    else is judged.  Number grounding blocks as well, phrases only warn.  ``scanned``: code, scan.
    ``missing_fields`` of the rules is optional.
    """
    incomplete = []
    if "missing_fields" in rules.columns:
        incomplete = [
            rules.filter(F.size("missing_fields") > 0).select(
                F.lit("blocking").alias("severity"),
                F.lit("missing_field").alias("rule"),
                F.coalesce("code", F.lit("*")).alias("code"),
                F.array_join("missing_fields", ",").alias("detail"),
            )
        ]
    known = leaves.select("code").distinct()
    unknown = rules.join(known, "code", "left_anti").select(
        F.lit("blocking").alias("severity"),
        F.lit("unknown_code").alias("rule"),
        "code",
        F.lit("").alias("detail"),
    )
    narrow = (
        rules.agg(F.count_distinct("section").alias("n"))
        .filter(F.col("n") < min_sections)
        .select(
            F.lit("blocking").alias("severity"),
            F.lit("few_sections").alias("rule"),
            F.lit("*").alias("code"),
            F.col("n").cast("string").alias("detail"),
        )
    )
    ungrounded = (
        scanned.join(rules.select("code").distinct(), "code", "left_semi")
        .filter(~passes(F.col("scan")))
        .select(
            F.lit("blocking").alias("severity"),
            F.lit("ungrounded_number").alias("rule"),
            "code",
            F.size(offending(F.col("scan"))).cast("string").alias("detail"),
        )
    )
    phrases = check_phrases(texts, rules).select(
        "code",
        F.explode(
            F.concat(
                F.transform(
                    "missing",
                    lambda p: F.struct(F.lit("missing_phrase").alias("rule"), p.alias("detail")),
                ),
                F.transform(
                    "forbidden",
                    lambda p: F.struct(F.lit("forbidden_phrase").alias("rule"), p.alias("detail")),
                ),
            )
        ).alias("f"),
    )
    warned = phrases.select(F.lit("warn").alias("severity"), "f.rule", "code", "f.detail")
    broken = unknown.unionByName(narrow)
    for part in incomplete:
        broken = broken.unionByName(part)
    # One row at most, so it may be broadcast.
    any_broken = broken.select(F.lit(1).alias("_broken")).limit(1)
    judged = ungrounded.unionByName(warned).withColumn("_broken", F.lit(1))
    return broken.unionByName(
        judged.join(F.broadcast(any_broken), "_broken", "left_anti").drop("_broken")
    )


def gate_verdict(findings: DataFrame) -> DataFrame:
    """One row: number of blocking findings and warnings, and whether the gate passes."""
    return findings.agg(
        F.count_if(F.col("severity") == "blocking").alias("n_blocking"),
        F.count_if(F.col("severity") == "warn").alias("n_warnings"),
    ).withColumn("passed", F.col("n_blocking") == 0)

"""Small dimension files: partners, taxonomy and sections as CSV, rule sets as JSON lines.

All columns are read as text, by the names in the header, so codes keep their leading zeros.  Quoted
fields may hold doubled quotes and line breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.taxonomy import latest_entries
from ..schemas import PARTNERS, RULES, RULES_REQUIRED, SECTIONS, TAXONOMY


def read_named(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a CSV file, wherever its header has them."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True).select(
        *columns, "_metadata"
    )


def read_partners(spark: SparkSession, path: str) -> DataFrame:
    """partner_code, partner_name, is_aggregate."""
    return read_named(spark, path, PARTNERS.fieldNames()).select(
        "partner_code",
        F.col("partner_desc").alias("partner_name"),
        (F.lower(F.trim("is_aggregate_code")) == "true").alias("is_aggregate"),
    )


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """code, description, section, parent, level; of a repeated code the last row wins."""
    rows = read_named(spark, path, TAXONOMY.fieldNames()).select(
        F.col("hscode").alias("code"),
        "description",
        "section",
        "parent",
        "level",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )
    return latest_entries(rows, "seq")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    return read_named(spark, path, SECTIONS.fieldNames()).drop("_metadata")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a file with one JSON object in a line; see ``parse_rules``."""
    return parse_rules(spark.read.text(path))


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules code, section, section_name, must, must_not, missing_fields, from text column ``value``.

    Blank lines are skipped; a line without some required fields is kept with their names.
    """
    lines = lines.filter(F.trim("value") != "")
    present = F.json_object_keys("value")
    parsed = lines.withColumn("r", F.from_json("value", RULES))
    return parsed.select(
        F.col("r.hs_code").alias("code"),
        F.col("r.section").alias("section"),
        F.col("r.section_name").alias("section_name"),
        F.col("r.description_must_reference").alias("must"),
        F.col("r.description_must_not_contain").alias("must_not"),
        F.array_except(
            F.array(*[F.lit(f) for f in RULES_REQUIRED]),
            F.coalesce(present, F.array().cast("array<string>")),
        ).alias("missing_fields"),
    )

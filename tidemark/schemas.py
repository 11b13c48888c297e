"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Upstream field names and those of the dimension and rule files.
RAW_RECORD = T.StructType(
    [
        T.StructField("reporterCode", T.IntegerType()),
        T.StructField("partnerCode", T.IntegerType()),
        T.StructField("period", T.StringType()),
        T.StructField("cmdCode", T.StringType()),
        T.StructField("flowCode", T.StringType()),
        T.StructField("primaryValue", T.DoubleType()),
        T.StructField("cifvalue", T.DoubleType()),
        T.StructField("fobvalue", T.DoubleType()),
        T.StructField("isReported", T.BooleanType()),
        T.StructField("isAggregate", T.BooleanType()),
    ]
)

# Fields without which a raw record breaks the contract.
RAW_REQUIRED = (
    "reporterCode",
    "partnerCode",
    "period",
    "cmdCode",
    "flowCode",
    "isReported",
    "isAggregate",
)

ENVELOPE = T.StructType(
    [
        T.StructField("count", T.IntegerType()),
        T.StructField("error", T.StringType()),
        T.StructField("data", T.ArrayType(RAW_RECORD)),
        T.StructField("_corrupt", T.StringType()),
    ]
)

PARTNERS = T.StructType(
    [
        T.StructField("partner_code", T.StringType()),
        T.StructField("partner_desc", T.StringType()),
        T.StructField("is_aggregate_code", T.StringType()),
    ]
)

TAXONOMY = T.StructType(
    [
        T.StructField("section", T.StringType()),
        T.StructField("hscode", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("level", T.StringType()),
    ]
)

SECTIONS = T.StructType(
    [T.StructField("section", T.StringType()), T.StructField("name", T.StringType())]
)

RULES = T.StructType(
    [
        T.StructField("hs_code", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("section_name", T.StringType()),
        T.StructField("description_must_reference", T.ArrayType(T.StringType())),
        T.StructField("description_must_not_contain", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
    ]
)

RULES_REQUIRED = (
    "hs_code",
    "section",
    "section_name",
    "description_must_reference",
    "description_must_not_contain",
)

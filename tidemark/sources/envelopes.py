"""Upstream JSON envelopes, one file per (item, flow, year), to raw records and a load manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trade import FLOW_CODES, ITEM_FLOW
from ..schemas import ENVELOPE, RAW_REQUIRED


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path/item_code=…/flow=…/year=…/``, parsed and judged.

    Returns item_code, flow, year, file, envelope, reason; ``reason`` is null for a good envelope.
    A whole envelope is rejected when its JSON is broken, when any record breaks the schema or
    when it reports an error.  The stated count is not compared with the records.
    """
    files = (
        spark.read.schema("value string, item_code string, flow string, year int")
        .text(path, wholetext=True)
        .select("item_code", "flow", "year", F.col("_metadata.file_path").alias("file"), "value")
    )
    parsed = files.withColumn(
        "envelope",
        F.from_json(
            "value",
            ENVELOPE,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
        ),
    )
    envelope = F.col("envelope")
    broken_record = F.exists(
        envelope["data"],
        lambda r: r.isNull() | F.exists(F.array(*[r[f].isNull() for f in RAW_REQUIRED]), lambda x: x),
    )
    bad_period = F.exists(envelope["data"], lambda r: r["period"].try_cast("int").isNull())
    reason = (
        F.when(
            envelope["_corrupt"].isNotNull() & F.expr("try_parse_json(value)").isNull(),
            F.lit("no JSON"),
        )
        .when(
            envelope["_corrupt"].isNotNull()
            | envelope["count"].isNull()
            | envelope["data"].isNull()
            | F.coalesce(broken_record | bad_period, F.lit(False)),
            F.lit("not an envelope"),
        )
        .when(
            F.length(envelope["error"]) > 0,
            F.concat(F.lit("the source says: "), envelope["error"]),
        )
    )
    return parsed.select(
        *ITEM_FLOW,
        "year",
        "file",
        F.col("envelope").alias("envelope"),
        reason.alias("reason"),
    )


def envelope_records(envelopes: DataFrame) -> DataFrame:
    """Raw records of the good envelopes, in file order.  ``seq`` orders records of an item."""
    return (
        envelopes.filter("reason IS NULL")
        .select(*ITEM_FLOW, "year", F.posexplode("envelope.data").alias("pos", "r"))
        .select(
            *ITEM_FLOW,
            F.col("r.partnerCode").alias("partner_code"),
            F.col("r.period").alias("period"),
            F.col("r.primaryValue").alias("primary_value"),
            F.col("r.cifvalue").alias("cif_value"),
            F.col("r.fobvalue").alias("fob_value"),
            F.col("r.isReported").alias("is_reported"),
            F.struct("year", "pos").alias("seq"),
        )
    )


def envelope_manifest(envelopes: DataFrame) -> DataFrame:
    """One row per envelope: item_code, flow, year, reason (null = loaded well)."""
    return envelopes.select(*ITEM_FLOW, "year", "reason")


def request_parameters(expected: DataFrame) -> DataFrame:
    """The upstream flow code of each expected (item, flow, year) load."""
    codes = F.create_map(*[F.lit(x) for pair in FLOW_CODES.items() for x in pair])
    return expected.withColumn("flow_code", codes[F.col("flow")])


def write_records(records: DataFrame, path: str) -> None:
    """Store normalised records partitioned by flow and year, clustered by item."""
    (
        records.repartition("flow", "year", "item_code")
        .sortWithinPartitions("item_code", "partner_code")
        .write.partitionBy("flow", "year")
        .mode("errorifexists")
        .parquet(path)
    )

"""Logical tables of this library built from a folder of star-schema parquet tables.

Real trade data is not part of this repository, so the registered queries run the operators on these
views.  Each view is a plain declarative plan over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import micros

REPORTER = "8"
AS_OF = "2001-09-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    A table stored as one row group is read by one task, which is slow when each row holds a long
    text.  A scan that already has a task per core, as any large table does, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def item_code(by: str) -> Column:
    """Item of a trade line: the brand (few dense items) or the part as a 6-digit code (many)."""
    if by == "brand":
        return F.col("p_brand")
    return part_code(F.col("p_partkey"))


def part_code(key: Column) -> Column:
    """Part key as text, zero-padded to at least six digits (longer keys keep all digits)."""
    text = key.cast("string")
    return F.concat(F.repeat(F.lit("0"), 6 - F.length(text)), text)


def _lines(spark: SparkSession, d: str, by: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"
    )
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    # Customers meet the orders, which are fewer than the lines.
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    if by == "brand":
        parts = table(spark, d, "part").select("p_partkey", "p_brand")
        joined = joined.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    else:
        joined = joined.withColumn("p_partkey", F.col("l_partkey"))
    return joined.select(
        "*",
        item_code(by).alias("item_code"),
        F.when(F.col("l_linestatus") == "F", "import").otherwise("export").alias("flow"),
        F.col("c_nationkey").cast("string").alias("partner_code"),
        F.year("o_orderdate").alias("year"),
        (
            (F.col("o_orderstatus") == "P")
            & (F.year("o_orderdate") >= 2000)
            & (F.col("l_orderkey") % 50 == 0)
        ).alias("is_provisional"),
    )


def partners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("string").alias("partner_code"),
        F.col("n_name").alias("partner_name"),
        (F.col("n_nationkey") % 12 == 0).alias("is_aggregate"),
    )


def trade(spark: SparkSession, d: str, by: str = "brand") -> DataFrame:
    """Trade records: one per (item, flow, partner, year); money summed as decimals.

    The partner name is joined after the reduction.
    """
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    reduced = (
        _lines(spark, d, by)
        .groupBy("item_code", "flow", "partner_code", "year")
        .agg(
            F.sum(money).cast("double").alias("value"),
            F.bool_or("is_provisional").alias("is_provisional"),
            F.min("l_orderkey").alias("seq"),
            F.count(F.lit(1)).alias("n_lines"),
            F.max("o_orderdate").alias("last_date"),
        )
    )
    names = partners(spark, d).select("partner_code", "partner_name")
    return reduced.join(names, "partner_code", "left")


def trade_raw(spark: SparkSession, d: str) -> DataFrame:
    """Un-normalised records, one per trade line.  ``seq`` is a sortable struct: no global sort."""
    price = F.col("l_extendedprice")
    return _lines(spark, d, "brand").select(
        "item_code",
        "flow",
        F.col("c_nationkey").alias("partner_code"),
        F.col("year").cast("string").alias("period"),
        F.when(F.col("l_quantity") >= 5, price).alias("primary_value"),
        (price * (1 + F.col("l_tax"))).alias("cif_value"),
        F.when(F.col("l_quantity") >= 2, price * (1 - F.col("l_discount"))).alias("fob_value"),
        (~F.col("is_provisional")).alias("is_reported"),
        F.struct(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_quantity",
            "l_extendedprice",
        ).alias("seq"),
    )


def load_manifest(records: DataFrame) -> DataFrame:
    """One load per (item, flow, year) of ``trade`` records, some failed by a fixed rule."""
    n_lines = F.sum("n_lines")
    return records.groupBy("item_code", "flow", "year").agg(
        n_lines.alias("n_lines"),
        F.when(
            n_lines % 13 == 0,
            F.concat(F.lit("upstream timeout after "), n_lines.cast("string")),
        ).alias("reason"),
    )


def trade_issues(records: DataFrame) -> DataFrame:
    """The failed loads of ``load_manifest`` as issue rows."""
    return (
        load_manifest(records)
        .filter("reason IS NOT NULL")
        .select("item_code", "flow", "year", "reason")
    )


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Three-level product tree from the part table: type, type/brand, part."""
    part = table(spark, d, "part")
    top = part.select(
        F.col("p_type").alias("code"),
        F.lower("p_type").alias("description"),
        F.col("p_type").alias("section"),
        F.lit("TOTAL").alias("parent"),
        F.lit("2").alias("level"),
    ).distinct()
    mid = part.select(
        F.concat_ws("/", "p_type", "p_brand").alias("code"),
        F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("description"),
        F.col("p_type").alias("section"),
        F.col("p_type").alias("parent"),
        F.lit("4").alias("level"),
    ).distinct()
    leaf = part.select(
        part_code(F.col("p_partkey")).alias("code"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("section"),
        F.concat_ws("/", "p_type", "p_brand").alias("parent"),
        F.lit("6").alias("level"),
    )
    return top.unionByName(mid).unionByName(leaf)


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Section names: types that start with S have none."""
    return (
        table(spark, d, "part")
        .select("p_type")
        .distinct()
        .filter("NOT startswith(p_type, 'S')")
        .select(
            F.col("p_type").alias("section"),
            F.concat(F.lower("p_type"), F.lit(" goods of all kinds")).alias("name"),
        )
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Analysis requests as raw JSON, one per order, some broken by fixed rules.

    A request asks for one part of its order's number range; ``seq`` is the order key.
    """
    key = F.col("o_orderkey")
    n_parts = table(spark, d, "part").select(F.count(F.lit(1)).alias("n")).scalar()
    code = part_code(key % n_parts)
    year = F.year("o_orderdate")

    def rule(modulus: int, rest: int) -> Column:
        return key % modulus == rest

    quoted_code = F.concat(
        F.lit('"hs_code":"'),
        F.when(rule(41, 7), F.lit("12a")).when(rule(43, 5), F.lit("999999")).otherwise(code),
        F.lit('"'),
    )
    flow = F.concat(
        F.lit(',"flow":"'),
        F.when(rule(37, 3), F.lit("sideways"))
        .when(rule(5, 0), F.lit("import"))
        .when(rule(5, 1), F.lit("export"))
        .otherwise(F.lit("both")),
        F.lit('"'),
    )
    start = F.when(rule(47, 2), F.lit(1961)).when(rule(53, 4), year - 25).otherwise(year - 2)
    years = (
        F.when(rule(3, 0), F.lit(""))
        .when(rule(3, 1), F.concat(F.lit(',"year_end":'), (year + 1).cast("string")))
        .otherwise(
            F.concat(
                F.lit(',"year_start":'),
                start.cast("string"),
                F.lit(',"year_end":'),
                (year + F.when(rule(59, 6), F.lit(-9)).otherwise(F.lit(2))).cast("string"),
            )
        )
    )
    tail = F.concat(
        F.when(rule(61, 8), F.lit(',"colour":"red"')).otherwise(F.lit("")),
        F.when(rule(67, 9), F.lit(',"partner_region":"EU"')).otherwise(F.lit("")),
        F.when(rule(71, 1), F.lit(',"value_or_volume":"volume"')).otherwise(F.lit("")),
        F.lit(',"tenant_id":"t'),
        (F.col("o_custkey") % 5).cast("string"),
        F.lit('","user_id":"'),
        F.col("o_custkey").cast("string"),
        F.lit('"'),
    )
    body = F.concat(F.lit("{"), quoted_code, flow, years, tail, F.lit("}"))
    raw = F.when(rule(73, 1), F.concat(F.lit("{"), quoted_code)).otherwise(body)
    return table(spark, d, "orders").select(
        key.alias("request_id"), raw.alias("raw"), F.col("o_orderdate").alias("requested_at")
    )


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    """One query vector per label: the component-wise mean of its vectors (not unit length)."""
    return (
        vectors(spark, d)
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("decimal(18,12)")).cast("double").alias("x"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
        .select("query_id", F.transform("parts", lambda p: p["x"]).alias("embedding"))
    )


def request_log(spark: SparkSession, d: str) -> DataFrame:
    """Call log from the events: key, call id, time, thread within tenant and day."""
    day = F.to_date("ts")
    return table(spark, d, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("call_id"),
        "ts",
        micros(F.col("ts")).alias("ts_us"),
        day.alias("day"),
        F.concat_ws("/", F.col("user_id").cast("string"), day.cast("string")).alias("thread_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
    )


def thread_runs(spark: SparkSession, d: str) -> DataFrame:
    """Workflow runs per conversation: system turns are errors, assistant turns are responses."""
    role = F.col("role")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("thread_id"),
        F.col("turn").alias("seq"),
        F.when(role == "system", F.lit("RUN_FAILED")).alias("error_code"),
        F.when(role == "assistant", F.sha2("text", 256)).alias("response"),
    )

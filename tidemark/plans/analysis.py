"""Trade analysis for a whole table of requests, and the nested analysis document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_numeric_tokens, whole
from ..operators import grounding, trade
from ..operators.requests import admit_requests, request_fingerprint, split_rejects
from ..operators.taxonomy import taxonomy_text
from ..session import materialize

ANALYSIS_KEY = ["hs_code", "flow", "year_start", "year_end"]

#: Cells of the items that one task works on, on average: with their tables they stay in memory.
CELLS_A_TASK = 1 << 17


def requested_windows(admitted: DataFrame) -> DataFrame:
    """Distinct (item, flow, window) of the valid requests; ``both`` asks for two flows."""
    flows = F.when(
        F.col("flow") == "both", F.array(F.lit("import"), F.lit("export"))
    ).otherwise(F.array("flow"))
    return (
        admitted.filter("error_code IS NULL")
        .select(
            F.col("hs_code").alias("item_code"),
            F.explode(flows).alias("flow"),
            "year_start",
            "year_end",
        )
        .distinct()
    )


def analysis_tables(
    admitted: DataFrame,
    records: DataFrame,
    partners: DataFrame,
    issues: DataFrame,
    reporter: str,
) -> DataFrame:
    """Trade tables of every window asked for, each computed once.

    Records are first cut to the items asked for, then reduced to cells, which are written once
    because ranking, flags and excluded codes all read them.
    """
    windows = materialize(requested_windows(admitted))
    items = windows.select("item_code").distinct()
    asked = records.join(items, "item_code", "left_semi")
    cells = materialize(trade.partner_cells(asked, partners, reporter))
    # Where the session's partitions would hold more, the windows are dealt into as many as that takes,
    # and all that meets them by item follows.
    tasks = -(-cells.count() // CELLS_A_TASK)
    if tasks > int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        windows = windows.repartition(tasks, "item_code")
    return trade.trade_table(cells, windows, issues)


def default_summary(analyses: DataFrame) -> DataFrame:
    """Default prose: the ranked totals of each flow.  A model may be plugged in instead."""

    def sentence(label: str, table: str) -> Column:
        rows = F.transform(
            F.col(table)["rows"],
            lambda r: F.concat(
                F.lit("rank "), r["rank"].cast("string"), F.lit(" "), whole(r["cumulative"])
            ),
        )
        span = F.concat(
            F.lit(label),
            F.lit(" over "),
            F.size(F.col(table)["years"]).cast("string"),
            F.lit(" years in USD: "),
        )
        return F.concat(span, F.array_join(rows, "; "), F.lit("."))

    head = F.concat(F.lit("HS code "), F.col("item_code"), F.lit("."))
    return analyses.withColumn(
        "analytical_summary",
        F.concat_ws(" ", head, sentence("Imports", "imports"), sentence("Exports", "exports")),
    )


def default_description(items: DataFrame) -> DataFrame:
    """Default description: the taxonomy text without any word that holds a digit."""
    return items.withColumn(
        "item_description", strip_numeric_tokens(F.col("taxonomy_text"))
    )


Writer = Callable[[DataFrame], DataFrame]


def trade_analysis(
    requests: DataFrame,
    taxonomy: DataFrame,
    sections: DataFrame,
    records: DataFrame,
    partners: DataFrame,
    issues: DataFrame,
    *,
    reporter: str,
    as_of: str,
    describe: Writer = default_description,
    summarize: Writer = default_summary,
) -> DataFrame:
    """One row per request: either its analysis or its first error.

    ``describe`` adds ``item_description`` to (item_code, taxonomy_text); it must hold no number.
    ``summarize`` adds ``analytical_summary`` to the distinct analyses (item_code, flow, year_start,
    year_end, imports, exports, import_block, export_block); every number of it is checked against
    those tables.  Equal requests share one analysis; identity columns come from each request.
    """
    admitted = materialize(admit_requests(requests, taxonomy, as_of).drop("raw", "reasons"))
    tables = analysis_tables(admitted, records, partners, issues, reporter)
    body = [c for c in tables.columns if c not in trade.WINDOW]
    nested = tables.select(*trade.WINDOW, F.struct(*body).alias("table"))
    distinct = (
        admitted.filter("error_code IS NULL")
        .select(F.col("hs_code").alias("item_code"), "flow", "year_start", "year_end")
        .distinct()
    )
    # Only items that are asked for get a description.
    asked_items = distinct.select("item_code").distinct()
    asked_texts = _item_texts(taxonomy, sections).join(asked_items, "item_code", "left_semi")
    described = _check_descriptions(describe(asked_texts))
    asks_import = F.col("flow").isin("import", "both")
    asks_export = F.col("flow").isin("export", "both")

    def table_of(flow: str) -> Column:
        window = {c: F.col(c) for c in ("year_start", "year_end")}
        return trade.among("_tables", flow=F.lit(flow), **window)["table"]

    def block_of(side: str) -> Column:
        text = trade.render_block(F.lit(side.upper()), F.col(side))
        return F.when(F.col(side).isNotNull(), text).alias(f"{side[:-1]}_block")

    # Tables, windows and descriptions meet by item; a block is rendered only where a writer reads it.
    analyses = (
        distinct.join(trade.by_item(nested, "_tables"), "item_code", "left")
        .select(
            "item_code",
            "flow",
            "year_start",
            "year_end",
            F.when(asks_import, table_of("import")).alias("imports"),
            F.when(asks_export, table_of("export")).alias("exports"),
        )
        .select("*", block_of("imports"), block_of("exports"))
    )
    checked = _check_summaries(summarize(analyses))
    sides = ("imports", "exports")
    results = (
        checked.join(described, "item_code", "left")
        .withColumnRenamed("item_code", "hs_code")
        .withColumns({c: trade.by_columns(F.col(c)) for c in sides})
    )
    identity = [c for c in admitted.columns if c not in ANALYSIS_KEY]
    keyed = admitted.select(
        *identity, *ANALYSIS_KEY, request_fingerprint().alias("fingerprint")
    )
    valid, rejected = split_rejects(keyed)
    absent = F.array(
        F.col("item_description").isNull(),
        F.col("analytical_summary").isNull(),
        F.coalesce(asks_import & F.col("imports").isNull(), F.lit(False)),
        F.coalesce(asks_export & F.col("exports").isNull(), F.lit(False)),
    )
    incomplete = F.when(F.exists(absent, lambda x: x), F.lit("INCOMPLETE_STATE"))
    # First error wins: request checks, description, summary, completeness.
    error = F.coalesce("error_code", "description_error", "summary_error", incomplete)
    joined = valid.join(results, ANALYSIS_KEY, "left").withColumn("error_code", error)
    joined = joined.withColumns({c: trade.by_rows(F.col(c)) for c in sides})
    # A failed request shows its error only; what could not be verified is not handed on.
    body = ("item_description", "imports", "exports", "analytical_summary")
    answered = joined.withColumns(
        {c: F.when(F.col("error_code").isNull(), F.col(c)) for c in body}
    ).drop("description_error", "summary_error")
    return answered.unionByName(rejected.drop(*ANALYSIS_KEY), allowMissingColumns=True)


def _item_texts(taxonomy: DataFrame, sections: DataFrame) -> DataFrame:
    return taxonomy_text(taxonomy, sections).select(
        F.col("code").alias("item_code"), "taxonomy_text"
    )


def _check_descriptions(items: DataFrame) -> DataFrame:
    return grounding.number_free(items.withColumn("text", F.col("item_description"))).select(
        "item_code",
        "item_description",
        F.when(~F.col("is_number_free"), F.lit("UNGROUNDED_DESCRIPTION")).alias(
            "description_error"
        ),
    )


def _check_summaries(analyses: DataFrame) -> DataFrame:
    """Each summary against the tables of its own analysis; nothing is joined for it."""
    none = F.array().cast("array<double>")

    def of_both(numbers: Callable[[Column, Column], Column]) -> Column:
        sides = [F.col(t) for t in ("imports", "exports")]
        return F.array_union(
            *[F.coalesce(numbers(t["years"], t["rows"]), none) for t in sides]
        )

    facts = F.array_union(
        of_both(grounding.fact_numbers), grounding.code_number(F.col("item_code"))
    )
    scan = grounding.scan_numbers(
        F.col("analytical_summary"), facts, of_both(grounding.structural_numbers)
    )
    return grounding.gate_texts(analyses.withColumn("scan", scan)).select(
        "item_code",
        "flow",
        "year_start",
        "year_end",
        "imports",
        "exports",
        "analytical_summary",
        F.col("error_code").alias("summary_error"),
        "offending",
    )


def analysis_document(analyses: DataFrame, provenance: dict[str, str], as_of: str) -> DataFrame:
    """Successful analyses as nested documents with provenance constants.

    ``provenance``: source, reporter_country, prompt_version; currency and period type are fixed.
    """
    facts = {
        "period_type": "calendar_year",
        "currency": "USD",
        **provenance,
    }
    return analyses.filter("error_code IS NULL").select(
        "request_id",
        "hs_code",
        F.struct(
            "request_id",
            "hs_code",
            "item_description",
            "imports",
            "exports",
            "analytical_summary",
            F.struct(
                F.lit(as_of).cast("timestamp").alias("retrieved_at"),
                *[F.lit(v).alias(k) for k, v in sorted(facts.items())],
            ).alias("provenance"),
        ).alias("document"),
    )


def write_documents(documents: DataFrame, path: str, fmt: str = "json") -> None:
    """Write the documents clustered by item, as JSON lines or parquet."""
    body = documents.select("document.*")
    body.sortWithinPartitions("hs_code").write.mode("errorifexists").format(fmt).save(path)

"""Trade records to ranked, year-by-year partner tables with honest completeness flags.

Records:  item_code, flow, partner_code, partner_name, year, value, is_provisional, seq
Windows:  item_code, flow, year_start, year_end
Partners: partner_code, partner_name, is_aggregate
Issues:   item_code, flow, year, reason

The record table is reduced once, to one row per (item, flow, partner, year), by an aggregation
with map-side combine.  Everything after that works on those cells, whose number per item is
limited by the partner dimension and the calendar and not by the number of records, so an item
that holds a third of all records is no larger than any other.

Cells, windows, issues and tables meet by item alone, in one partitioning that every later grouping by
item and more fits into: nested rows stay where they were made.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import whole

ITEM_FLOW = ["item_code", "flow"]
WINDOW = [*ITEM_FLOW, "year_start", "year_end"]
TOP_N = 10

# Upstream codes of the two flows.
FLOW_CODES = {"import": "M", "export": "X"}


def flow_code(flow: Column) -> Column:
    pairs = [F.lit(x) for pair in FLOW_CODES.items() for x in pair]
    return F.create_map(*pairs)[flow]


def normalize_records(raw: DataFrame) -> DataFrame:
    """Codes to strings, period to year, value with its per-flow fallback, provisional flag."""
    fallback = F.when(F.col("flow") == "import", F.col("cif_value")).otherwise(F.col("fob_value"))
    return raw.select(
        "item_code",
        "flow",
        flow_code(F.col("flow")).alias("flow_code"),
        F.col("partner_code").cast("string").alias("partner_code"),
        F.col("period").cast("int").alias("year"),
        F.coalesce("primary_value", fallback).alias("value"),
        (~F.col("is_reported")).alias("is_provisional"),
        "seq",
    )


def with_partner_names(records: DataFrame, partners: DataFrame) -> DataFrame:
    """Add ``partner_name``; a code without a name keeps its row and gets a labelled placeholder."""
    names = partners.select("partner_code", F.col("partner_name").alias("_name"))
    placeholder = F.concat(F.lit("Unknown partner ("), F.col("partner_code"), F.lit(")"))
    return (
        records.join(names, "partner_code", "left")
        .withColumn("partner_name", F.coalesce("_name", placeholder))
        .drop("_name")
    )


def flag_excluded(df: DataFrame, partners: DataFrame, reporter: str) -> DataFrame:
    """Mark catch-all codes and the reporter itself; unknown codes are not excluded."""
    flags = partners.select("partner_code", F.col("is_aggregate").alias("_aggregate"))
    return (
        df.join(flags, "partner_code", "left")
        .withColumn(
            "is_excluded",
            F.coalesce("_aggregate", F.lit(False)) | (F.col("partner_code") == reporter),
        )
        .drop("_aggregate")
    )


def strip_partners(records: DataFrame, partners: DataFrame, reporter: str) -> DataFrame:
    """Records of real partner countries only."""
    return flag_excluded(records, partners, reporter).filter("NOT is_excluded").drop("is_excluded")


def last_wins(records: DataFrame) -> DataFrame:
    """One cell per (item, flow, partner, year): value of the last record, even if null.

    ``first_seen`` carries the earliest (seq, name) so that the partner name can come from the
    first record over all years.
    """
    return records.groupBy(*ITEM_FLOW, "partner_code", "year").agg(
        F.max_by("value", "seq").alias("value"),
        F.min(F.struct("seq", "partner_name")).alias("first_seen"),
        F.count(F.lit(1)).alias("n_records"),
        F.bool_and(~F.col("is_provisional")).alias("all_reported"),
    )


def partner_cells(records: DataFrame, partners: DataFrame, reporter: str) -> DataFrame:
    """``last_wins`` cells with the exclusion flag, joined after the reduction."""
    return flag_excluded(last_wins(records), partners, reporter)


def by_item(parts: DataFrame, name: str) -> DataFrame:
    """One row per item with all its rows as a list of structs; an item has few."""
    body = [c for c in parts.columns if c != "item_code"]
    return parts.groupBy("item_code").agg(F.collect_list(F.struct(*body)).alias(name))


def among(name: str, **same: Column) -> Column:
    """The struct of a ``by_item`` list whose fields have the given values, null if there is none."""

    def fits(part: Column) -> Column:
        return reduce(and_, [part[field] == value for field, value in same.items()])

    return F.get(F.filter(name, fits), F.lit(0))


def at_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Each row once for every window of its item and flow."""
    own = F.filter("_windows", lambda w: w["flow"] == F.col("flow"))
    return (
        rows.join(by_item(windows.select(*WINDOW), "_windows"), "item_code")
        .withColumn("_window", F.explode(own))
        .select(
            *rows.columns,
            F.col("_window.year_start").alias("year_start"),
            F.col("_window.year_end").alias("year_end"),
        )
    )


def excluded_codes(cells: DataFrame) -> DataFrame:
    """Excluded partner codes present per (item, flow), sorted as text."""
    return (
        cells.filter("is_excluded")
        .groupBy(*ITEM_FLOW)
        .agg(F.array_sort(F.collect_set("partner_code")).alias("excluded_partner_codes"))
    )


def fixed_windows(records: DataFrame, year_start: int, year_end: int) -> DataFrame:
    """The same window for every (item, flow) present."""
    return (
        records.select(*ITEM_FLOW)
        .distinct()
        .withColumn("year_start", F.lit(year_start))
        .withColumn("year_end", F.lit(year_end))
    )


def year_list() -> Column:
    return F.sequence(F.col("year_start"), F.col("year_end"))


def dense_years(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Every kept partner times every year of its window; an absent year has a null value."""
    kept = cells.filter("NOT is_excluded")
    scaffold = (
        kept.select(*ITEM_FLOW, "partner_code")
        .distinct()
        .join(windows, ITEM_FLOW)
        .withColumn("year", F.explode(year_list()))
    )
    values = kept.select(*ITEM_FLOW, "partner_code", "year", "value")
    return scaffold.join(values, [*ITEM_FLOW, "partner_code", "year"], "left")


def partner_totals(cells: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window and kept partner: name, value per year of the window, and the total.

    Years outside the window add nothing, but their partner stays with a total of 0.0.  The total
    is folded in year order, so it does not depend on how rows were partitioned.
    """
    in_window = F.col("year").between(F.col("year_start"), F.col("year_end"))
    grid = (
        at_windows(cells.filter("NOT is_excluded"), windows)
        .groupBy(*WINDOW, "partner_code")
        .agg(
            F.min("first_seen")["partner_name"].alias("partner_name"),
            F.map_from_entries(
                F.collect_list(F.when(in_window, F.struct("year", "value")))
            ).alias("known"),
        )
    )
    years = year_list()
    return (
        grid.withColumn(
            "values_by_year",
            F.map_from_arrays(years, F.transform(years, lambda y: F.col("known")[y])),
        )
        .withColumn(
            "cumulative",
            F.aggregate(
                F.map_values("values_by_year"),
                F.lit(0.0),
                lambda acc, v: acc + F.coalesce(v, F.lit(0.0)),
            ),
        )
        .drop("known")
    )


def rank_partners(cells: DataFrame, windows: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Top partners by total, ties by name then code.  ``rank <= n`` is pruned before the shuffle."""
    order = Window.partitionBy(*WINDOW).orderBy(F.desc("cumulative"), "partner_name", "partner_code")
    return (
        partner_totals(cells, windows)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_n)
    )


def pivot_years(cells: DataFrame, year_start: int, year_end: int) -> DataFrame:
    """Wide form: one column ``y<year>`` per year, null where missing."""
    years = list(range(year_start, year_end + 1))
    wide = (
        cells.filter("NOT is_excluded")
        .groupBy(*ITEM_FLOW, "partner_code")
        .pivot("year", years)
        .agg(F.first("value"))
    )
    return wide.select(
        *ITEM_FLOW, "partner_code", *[F.col(str(y)).alias(f"y{y}") for y in years]
    )


def partition_finality(records: DataFrame) -> DataFrame:
    """Finality of each loaded (item, flow, year) over ALL its records, catch-alls included.

    This one steers how long a load stays fresh and deliberately differs from ``year_status``.
    """
    return records.groupBy(*ITEM_FLOW, "year").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.bool_and(~F.col("is_provisional")).alias("is_finalized"),
    )


def year_status(cells: DataFrame, windows: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per window year: finalised / no data / fetch failed, over kept records only."""
    cell = F.when(F.col("flow").isNotNull() & F.col("year").isNotNull(), F.struct("flow", "year"))
    observed = (
        cells.filter("NOT is_excluded")
        .groupBy("item_code")
        .agg(
            F.collect_set(F.when(F.col("all_reported"), cell)).alias("_reported"),
            F.collect_set(F.when(~F.col("all_reported"), cell)).alias("_open"),
        )
    )
    failed = issues.groupBy("item_code").agg(F.collect_set(cell).alias("_failed"))

    def has(cells_of: str) -> Column:
        here = F.struct("flow", "year")
        return F.coalesce(F.array_contains(cells_of, here), F.lit(False)) & F.col("flow").isNotNull()

    return (
        windows.join(observed, "item_code", "left")
        .join(failed, "item_code", "left")
        .withColumn("year", F.explode(year_list()))
        .select(
            *WINDOW,
            "year",
            (has("_reported") & ~has("_open")).alias("is_finalized"),
            (~has("_reported") & ~has("_open") & ~has("_failed")).alias("is_no_data"),
            has("_failed").alias("fetch_failed"),
        )
    )


def fetch_issues(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Expected (item, flow, year) loads that are absent or failed, with the reason.

    ``manifest`` holds item_code, flow, year, reason (null reason = loaded well).
    """
    loaded = manifest.select(*ITEM_FLOW, "year", "reason", F.lit(True).alias("_known"))
    return (
        expected.join(loaded, [*ITEM_FLOW, "year"], "left")
        .filter(F.col("_known").isNull() | F.col("reason").isNotNull())
        .select(
            *ITEM_FLOW, "year", F.coalesce("reason", F.lit("no load recorded")).alias("reason")
        )
    )


def issue_lists(issues: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: issue texts "year: reason" and issue years, both in year order."""
    per_window = (
        at_windows(issues, windows)
        .filter(F.col("year").between(F.col("year_start"), F.col("year_end")))
        .groupBy(*WINDOW)
        .agg(F.array_sort(F.collect_list(F.struct("year", "reason"))).alias("_issues"))
    )
    return per_window.select(
        *WINDOW,
        F.transform(
            "_issues", lambda i: F.concat(i["year"].cast("string"), F.lit(": "), i["reason"])
        ).alias("fetch_issues"),
        F.transform("_issues", lambda i: i["year"]).alias("fetch_issue_years"),
    )


def trade_table(
    cells: DataFrame, windows: DataFrame, issues: DataFrame, top_n: int = TOP_N
) -> DataFrame:
    """One nested table per window: years, their flags, issues, excluded codes, ranked rows.

    The parts are all dealt out by item, so the final joins move nothing.
    """
    rows = (
        rank_partners(cells, windows, top_n)
        .groupBy(*WINDOW)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "rank", "partner_name", "partner_code", "values_by_year", "cumulative"
                    )
                ),
                lambda a, b: a["rank"] - b["rank"],
            ).alias("rows")
        )
    )
    flags = (
        year_status(cells, windows, issues)
        .groupBy(*WINDOW)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("is_finalized"), F.col("year")))).alias(
                "years_finalized"
            ),
            F.array_sort(F.collect_list(F.when(F.col("is_no_data"), F.col("year")))).alias(
                "years_no_data"
            ),
        )
    )
    no_text = F.array().cast("array<string>")
    no_years = F.array().cast("array<int>")
    window = {c: F.col(c) for c in WINDOW if c != "item_code"}
    return (
        flags.join(by_item(excluded_codes(cells), "_excluded"), "item_code", "left")
        .withColumn("excluded_partner_codes", among("_excluded", flow=F.col("flow"))["excluded_partner_codes"])
        .drop("_excluded")
        .join(by_item(issue_lists(issues, windows), "_issues"), "item_code", "left")
        .withColumn("_issues", among("_issues", **window))
        .join(by_item(rows, "_rows"), "item_code", "left")
        .withColumn("rows", among("_rows", **window)["rows"])
        .select(
            *WINDOW,
            F.lit("USD").alias("unit"),
            year_list().alias("years"),
            "years_finalized",
            "years_no_data",
            F.coalesce("_issues.fetch_issues", no_text).alias("fetch_issues"),
            F.coalesce("_issues.fetch_issue_years", no_years).alias("fetch_issue_years"),
            F.coalesce("excluded_partner_codes", no_text).alias("excluded_partner_codes"),
            F.coalesce("rows", F.array().cast(_ROWS_TYPE)).alias("rows"),
        )
    )


_ROWS_TYPE = (
    "array<struct<rank:int,partner_name:string,partner_code:string,"
    "values_by_year:map<int,double>,cumulative:double>>"
)


def by_columns(table: Column) -> Column:
    """A table as a struct of ``trade_table`` columns with one list for each field of its rows, to be moved."""
    rows = table["rows"]
    kept = [
        table[c].alias(c)
        for c in (
            "years_finalized",
            "years_no_data",
            "fetch_issues",
            "fetch_issue_years",
            "excluded_partner_codes",
        )
    ]
    lists = [rows[c].alias(c) for c in ("partner_name", "partner_code", "cumulative")]
    values = F.flatten(F.transform(rows, lambda r: F.map_values(r["values_by_year"])))
    return F.when(
        table.isNotNull(),
        F.struct(table["unit"].alias("unit"), *kept, *lists, values.alias("values")),
    )


def by_rows(moved: Column) -> Column:
    """What ``by_columns`` was given, in a frame that has its window."""
    years, n = year_list(), F.col("year_end") - F.col("year_start") + 1

    def row(name: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).alias("rank"),
            name.alias("partner_name"),
            F.get(moved["partner_code"], i).alias("partner_code"),
            F.map_from_arrays(years, F.slice(moved["values"], i * n + 1, n)).alias("values_by_year"),
            F.get(moved["cumulative"], i).alias("cumulative"),
        )

    def same(*names: str) -> list[Column]:
        return [moved[c].alias(c) for c in names]

    return F.when(
        moved.isNotNull(),
        F.struct(
            *same("unit"),
            years.alias("years"),
            *same("years_finalized", "years_no_data", "fetch_issues", "fetch_issue_years"),
            *same("excluded_partner_codes"),
            F.transform(moved["partner_name"], row).alias("rows"),
        ),
    )


def render_block(label: Column, table: Column | None = None) -> Column:
    """A ``trade_table`` row as plain text; ``table`` is a struct of its columns, if it is one.

    The note on unfinalised years lists every year that is not finalised, so years without data
    and failed years appear in it too.
    """
    rows, years, finalized, codes = (
        F.col(c) if table is None else table[c]
        for c in ("rows", "years", "years_finalized", "excluded_partner_codes")
    )

    def cell(row: Column, year: Column) -> Column:
        value = row["values_by_year"][year]
        return F.concat(
            year.cast("string"), F.lit(": "), F.coalesce(whole(value), F.lit("no data"))
        )

    # Wording of the rendered block.
    head = F.concat(
        label, F.lit(" (USD, top "), F.size(rows).cast("string"), F.lit(" partner countries):")
    )
    lines = F.transform(
        rows,
        lambda r: F.concat(
            F.lit("  #"),
            r["rank"].cast("string"),
            F.lit(" "),
            r["partner_name"],
            F.concat(F.lit(" — "), F.size(years).cast("string"), F.lit("yr cumulative ")),
            whole(r["cumulative"]),
            F.lit(" USD | by year: "),
            F.array_join(F.transform(years, lambda y: cell(r, y)), ", "),
        ),
    )
    empty = F.when(F.size(rows) == 0, F.lit("  (no partner-country data available)"))
    excluded = F.when(
        F.size(codes) > 0,
        F.concat(
            F.lit("  (excluded aggregate/unspecified-partner codes, not shown above: "),
            F.array_join(codes, ", "),
            F.lit(")"),
        ),
    )
    open_years = F.array_except(years, finalized)
    unfinalized = F.when(
        F.size(open_years) > 0,
        F.concat(
            F.lit("  (provisional / not yet finalized years — subject to revision: "),
            F.array_join(open_years.cast("array<string>"), ", "),
            F.lit(")"),
        ),
    )
    return F.concat_ws("\n", F.array(head), lines, F.array_compact(F.array(empty, excluded, unfinalized)))

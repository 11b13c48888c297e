"""Validation of request tables: every row leaves either valid or with its reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import fingerprint, first_reason

# Limits and vocabularies of a request.
CODE_PATTERN = r"^\d{6}\z"
FLOWS = ("import", "export", "both")
MEASURES = ("value", "volume")
FIELDS = (
    "hs_code",
    "flow",
    "year_start",
    "year_end",
    "partner_region",
    "value_or_volume",
    "tenant_id",
    "user_id",
)
EARLIEST_YEAR = 1962
MAX_SPAN = 20
MAX_TEXT = 128
MAX_QUERY_TEXT = 200
MAX_BYTES = 65_536
WINDOW_YEARS = 5
LEAF_LEVEL = "6"


def _as_of_year(as_of: str) -> Column:
    return F.year(F.lit(as_of).cast("timestamp"))


def parse_requests(requests: DataFrame) -> DataFrame:
    """Read the raw JSON object of each request into typed columns, defaults filled in.

    Column ``_f`` holds the fields as text, ``_kinds`` the JSON kind of each; both are null unless the
    whole text is one JSON object.
    """
    # Each parser's result is the row of a one-element array: Spark would put a plain column in place of
    # all its uses when it pushes down a filter, and parse the text once for each of them.
    # The parser stops after one value; inside brackets, what follows it is an error or a second value.
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("raw"), F.lit("]")))
    read = requests.select("*", F.inline(F.array(F.struct(whole.alias("_whole")))))
    is_object = F.schema_of_variant("_whole").startswith("ARRAY<OBJECT") & F.try_variant_get(
        "_whole", "$[1]", "variant"
    ).isNull()
    field = F.from_json("raw", "map<string,string>", {"mode": "PERMISSIVE"})
    kinds = F.from_json("raw", "map<string,variant>", {"mode": "PERMISSIVE"})
    kinds = F.transform_values(kinds, lambda _, v: F.schema_of_variant(v))
    maps = F.struct(F.when(F.col("_ok"), field).alias("_f"), F.when(F.col("_ok"), kinds).alias("_kinds"))
    parsed = read.withColumn("_ok", is_object).select(*requests.columns, F.inline(F.array(maps)))

    def text(name: str) -> Column:
        return F.col("_f")[name]

    return parsed.select(
        *requests.columns,
        "_f",
        "_kinds",
        text("hs_code").alias("hs_code"),
        F.coalesce(text("flow"), F.lit("both")).alias("flow"),
        text("year_start").try_cast("int").alias("year_start"),
        text("year_end").try_cast("int").alias("year_end"),
        text("partner_region").alias("partner_region"),
        F.coalesce(text("value_or_volume"), F.lit("value")).alias("value_or_volume"),
        F.coalesce(text("tenant_id"), F.lit("default")).alias("tenant_id"),
        F.coalesce(text("user_id"), F.lit("default")).alias("user_id"),
    )


def validate_requests(requests: DataFrame, as_of: str) -> DataFrame:
    """Parsed requests with ``reasons``: an array of reject codes, empty for a valid request.

    Beyond the plain shape rules, filters that are reserved (region, volume) are rejected when they
    are not at their default, because no operator would honour them.
    """
    parsed = parse_requests(requests)
    start, end, keys = F.col("year_start"), F.col("year_end"), F.col("_f")

    def long_text(name: str) -> Column:
        return F.length(name) > MAX_TEXT

    def not_a_year(name: str) -> Column:
        return keys[name].isNotNull() & F.col(name).isNull()

    def kind_among(name: str, *kinds: str) -> Column:
        return ~F.array_contains(F.map_keys("_kinds"), name) | F.col("_kinds")[name].isin(*kinds)

    # A field that is given must be of its JSON kind; null is allowed where there is no default.
    mistyped = ~(
        kind_among("hs_code", "STRING")
        & kind_among("flow", "STRING")
        & kind_among("value_or_volume", "STRING")
        & kind_among("tenant_id", "STRING")
        & kind_among("user_id", "STRING")
        & kind_among("partner_region", "STRING", "VOID")
        & ~F.coalesce(F.col("_kinds")["year_start"] == "BOOLEAN", F.lit(False))
        & ~F.coalesce(F.col("_kinds")["year_end"] == "BOOLEAN", F.lit(False))
    )

    latest = _as_of_year(as_of) + 1
    unknown = F.size(F.array_except(F.map_keys(keys), F.array(*[F.lit(f) for f in FIELDS]))) > 0
    reasons = first_reason(
        (F.octet_length("raw") > MAX_BYTES, "REQUEST_TOO_LARGE"),
        (keys.isNull() | (F.size(keys) == 0), "MALFORMED_JSON"),
        (unknown, "UNKNOWN_FIELD"),
        (mistyped, "BAD_TYPE"),
        (~F.coalesce(F.col("hs_code").rlike(CODE_PATTERN), F.lit(False)), "BAD_CODE"),
        (~F.col("flow").isin(*FLOWS), "BAD_FLOW"),
        (~F.col("value_or_volume").isin(*MEASURES), "BAD_MEASURE"),
        (
            long_text("partner_region") | long_text("tenant_id") | long_text("user_id"),
            "TEXT_TOO_LONG",
        ),
        (not_a_year("year_start") | not_a_year("year_end"), "BAD_YEAR"),
        ((start < EARLIEST_YEAR) | (end < EARLIEST_YEAR), "YEAR_TOO_EARLY"),
        ((start > latest) | (end > latest), "YEAR_TOO_LATE"),
        (start > end, "YEAR_ORDER"),
        (end - start + 1 > MAX_SPAN, "YEAR_SPAN"),
        (
            F.col("partner_region").isNotNull() | (F.col("value_or_volume") == "volume"),
            "RESERVED_FILTER",
        ),
    )
    return parsed.withColumn("reasons", reasons).drop("_f", "_kinds")


def validate_search(queries: DataFrame, max_chars: int = MAX_QUERY_TEXT) -> DataFrame:
    """Search texts with ``error_code`` set unless they hold 1 to ``max_chars`` characters."""
    size = F.coalesce(F.length("query_text"), F.lit(0))
    return queries.withColumn(
        "error_code",
        F.when(size == 0, F.lit("EMPTY_TEXT")).when(size > max_chars, F.lit("TEXT_TOO_LONG")),
    )


def resolve_windows(requests: DataFrame, as_of: str) -> DataFrame:
    """Fill the year window: end defaults to last year, start to a five-year window."""
    end = F.coalesce(F.col("year_end"), _as_of_year(as_of) - 1)
    return requests.withColumn("year_end", end).withColumn(
        "year_start", F.coalesce(F.col("year_start"), F.col("year_end") - (WINDOW_YEARS - 1))
    )


def window_reason() -> Column:
    """Range rules again on the resolved window: one given bound may still make it too wide."""
    return F.when(F.col("year_start") > F.col("year_end"), F.lit("YEAR_ORDER")).when(
        F.col("year_end") - F.col("year_start") + 1 > MAX_SPAN, F.lit("YEAR_SPAN")
    )


def leaf_codes(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.filter(F.col("level") == LEAF_LEVEL)


def allowlisted(rows: DataFrame, taxonomy: DataFrame, code: str) -> DataFrame:
    """Add ``is_known``: the code exists in the taxonomy and is a leaf."""
    known = leaf_codes(taxonomy).select(F.col("code").alias(code)).distinct()
    return (
        rows.join(known.withColumn("_known", F.lit(True)), code, "left")
        .withColumn("is_known", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def admit_requests(requests: DataFrame, taxonomy: DataFrame, as_of: str) -> DataFrame:
    """Staged checks; the first failing stage sets ``error_code`` and later stages keep it.

    Stages: request shape, taxonomy membership, resolved window.
    """
    shaped = validate_requests(requests, as_of).withColumn(
        "error_code", F.when(F.size("reasons") > 0, F.col("reasons")[0])
    )
    # Rejected rows need no lookup.  They join on a key that no code equals and that differs from
    # row to row: a null key would send all of them to one task.
    nowhere = F.concat(F.lit("rejected "), F.xxhash64("raw").cast("string"))
    coded = shaped.withColumn(
        "_code", F.when(F.col("error_code").isNull(), F.col("hs_code")).otherwise(nowhere)
    )
    member = allowlisted(coded, taxonomy, "_code")
    staged = member.withColumn(
        "error_code",
        F.coalesce("error_code", F.when(~F.col("is_known"), F.lit("INVALID_HS_CODE"))),
    )
    resolved = resolve_windows(staged, as_of)
    return resolved.withColumn("error_code", F.coalesce("error_code", window_reason())).drop(
        "_code", "is_known"
    )


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) by ``error_code``."""
    return rows.filter("error_code IS NULL"), rows.filter("error_code IS NOT NULL")


def request_fingerprint() -> Column:
    """Key part of a request: its filters, without code, years and identity."""
    return fingerprint(F.col("flow"), F.col("partner_region"), F.col("value_or_volume"))


def coalesce_requests(requests: DataFrame, key: list[str], compute) -> DataFrame:
    """Compute each distinct key once and join the result back to every request.

    ``compute`` maps a DataFrame of distinct keys to a DataFrame with the key and result columns.
    A key asked for by a third of all requests is one row in ``compute``; the join back is left to
    adaptive execution, which broadcasts a small result or splits the hot key.
    """
    results = compute(requests.select(*key).distinct())
    return requests.join(results, key, "left")

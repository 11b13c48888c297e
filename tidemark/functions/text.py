"""Column functions over text: tokens, numbers, codes, phrases and rendered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters, digits of any script, and the underscore.  Java's own \w is ASCII-only.
WORD = r"[\p{L}\p{N}_]+"

# A number: thousands-grouped or plain, optional fraction.  Never starts inside a digit run, so the
# hyphen of "2019-2023" is not a minus sign.
NUMBER = r"(?<!\d)-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"

CODE = r"\b\d{6}\b"

#: Characters of the texts that one task cuts into words to count them, on average; the counts stay in memory.
CHARS_A_TASK = 8 << 20


def tokens(text: Column) -> Column:
    """Lower-case word runs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def explode_tokens(
    df: DataFrame, text: str, *keep: str | Column, keep_empty: bool = False
) -> DataFrame:
    """One row per token: the columns ``keep``, ``n_tokens`` of the text, and ``term``.

    With ``keep_empty`` a text without tokens keeps one row with a null term.

    The outer explode with a filter behind it equals an inner one, but stops Spark from testing the
    token array for emptiness in front of it, which would tokenise every text several times.
    """
    words = df.select(*keep, tokens(F.col(text)).alias("_words"))
    rest = [c for c in words.columns if c != "_words"]
    exploded = words.select(
        *rest, F.size("_words").alias("n_tokens"), F.explode_outer("_words").alias("term")
    )
    return exploded if keep_empty else exploded.filter("term IS NOT NULL")


def dealt_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``texts`` dealt out by ``key``, in as many tasks as their length asks for, at least one per core.

    Words counted by ``key`` and more then stay where they are, and a task's counts do not grow with the
    size of the files or with the number of texts.
    """
    chars = texts.agg(F.sum(F.length(text))).first()[0] or 0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(max(cores, -(-chars // CHARS_A_TASK)), key)


def as_number(token: Column) -> Column:
    return F.regexp_replace(token, ",", "").cast("double")


def numbers(text: Column) -> Column:
    """Every number of the text, in order, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), as_number)


def strip_numeric_tokens(text: Column) -> Column:
    """The text without any whitespace-delimited token that holds a digit."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: (w != "") & ~w.rlike(r"\d"))
    return F.array_join(words, " ")


def codes(text: Column, limit: int | None = None) -> Column:
    """Distinct 6-digit codes in order of first appearance, at most ``limit`` if one is given."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)))
    return found if limit is None else F.slice(found, 1, limit)


def whole(value: Column) -> Column:
    """Number with thousands commas and no decimals, rounded half to even."""
    return F.format_number(value, 0)


def missing_phrases(text: Column, phrases: Column) -> Column:
    """Phrases the text should contain but does not (case-insensitive)."""
    low = F.lower(text)
    return F.filter(phrases, lambda p: ~F.contains(low, F.lower(p)))


def present_phrases(text: Column, phrases: Column) -> Column:
    """Phrases the text contains (case-insensitive)."""
    low = F.lower(text)
    return F.filter(phrases, lambda p: F.contains(low, F.lower(p)))


def numbered_candidates(query_text: Column, candidates: Column) -> Column:
    """A query and its candidates (array of struct ``code, description``) as a numbered list."""
    # Wording of the list.
    lines = F.transform(
        candidates,
        lambda c, i: F.concat(
            (i + 1).cast("string"), F.lit(". "), c["code"].cast("string"), F.lit(": "), c["description"]
        ),
    )
    head = F.array(
        F.concat(F.lit('Search text: "'), query_text, F.lit('"')), F.lit(""), F.lit("Candidates:")
    )
    return F.array_join(F.concat(head, lines), "\n")

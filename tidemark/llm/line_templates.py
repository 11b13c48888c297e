"""Line dedup with a log-template tree, in DataFrame functions only.

The tree has a fixed depth: lines are parsed by their number of tokens and by their DEPTH leading tokens,
where a token with a digit is a variable field (``<*>``).  A leaf that lines of too few documents reach is
left alone.  In any other leaf, the token that most documents have at a position (more than half, each
pattern counted once per document) is constant there, and positions without one are variable.  Lines that
agree with at least SIMILARITY of their positions belong to the leaf's template; any other line is a
template of its own.  A template of lines from at least MIN_DOCS documents recurs: it stays in the
document with the smallest id and is dropped from all others.

Tokens are separated by spaces, tabs or carriage returns.  Lines of fewer than MIN_TOKENS tokens, such as
blank ones, are never dropped: too little to tell a template by.  Null and empty texts have one empty
line.  A null id sorts first.  Rows with one id are one document.  ``drop_recurring`` keeps all other
columns, counts ``n_chars`` anew if it is there, and leaves out documents of which nothing is left.

With ``every``, literal copies of a line go too, whatever the number of tokens, so that short lines and
scripts without blanks have a way of their own: a line of MIN_TOKENS tokens or LONG characters recurs from
two documents on, a shorter one from MIN_DOCS on.  Only blank lines are left out.  A leaf then may also
hold several templates, made of the tokens that at least MIN_DOCS of its documents have at a position.
A line that is no literal copy then needs a constant literal beyond the leading tokens, SIMILARITY of its
literals constant, and as many literals as fields at least, to belong to a template.

Only hashes and counts of lines are shuffled, each hot leaf or pattern is summed up before, and a text
moves twice: once where it is asked for the words of a pattern, and once to be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import whole_text

DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 10
SIMILARITY = 0.7
#: Characters from which on a line of few tokens is no chance copy.
LONG = 20
VARIABLE = "<*>"


def spaced(line: Column) -> Column:
    """The line's tokens separated by single spaces."""
    return F.trim(F.regexp_replace(line, r"[ \t\r]+", " "))


def normalised(line: Column) -> Column:
    """The line's tokens separated by single spaces, tokens with a digit as variable fields."""
    # Most lines need nothing; one pass over a character class and plain searches tell.
    as_is = ~(
        line.rlike(r"[0-9\t\r]") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    )
    return F.when(as_is, line).otherwise(F.regexp_replace(spaced(line), "[^ ]*[0-9][^ ]*", VARIABLE))


def n_tokens(norm: Column) -> Column:
    """How many tokens a normalised line has."""
    return F.when(norm == "", 0).otherwise(
        F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1
    )


def keyed(docs: DataFrame) -> DataFrame:
    """row (a hash of id and text), doc, text, and the whole row as ``whole``."""
    text = whole_text(F.col("text"))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(
        F.xxhash64(doc, text).alias("row"), doc.alias("doc"), text.alias("text"), F.struct("*").alias("whole")
    )


def parsed_lines(rows: DataFrame) -> DataFrame:
    """row, doc, line_no, leaf, pattern, n (its number of tokens) of every line.

    Short lines are left for the caller to drop once this is written: a filter here would be pushed below
    and parse every line twice.
    """
    lines = rows.select("row", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("norm", normalised(F.col("line")))
    lines = lines.withColumn("n", n_tokens(F.col("norm")))
    return lines.select(
        "row",
        "doc",
        "line_no",
        F.xxhash64("n", F.substring_index("norm", " ", DEPTH)).alias("leaf"),
        F.xxhash64("norm").alias("pattern"),
        "n",
    )


def in_enough_docs(lines: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The keys that lines of at least so many documents have, with the number and the first document."""
    return (
        lines.select(*keys, "doc")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc"))
        .where(F.col("docs") >= least)
    )


def pattern_words(rows: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaf, pattern, n, docs of every pattern; and position and token of each of its words after the
    leading ones, with the number of its literals, and of those among its leading words."""
    patterns = materialize(
        lines.groupBy("leaf", "pattern", "n")
        .agg(F.min(F.struct("row", "line_no")).alias("at"))
        .join(in_enough_docs(lines, ["leaf", "pattern"], 1), ["leaf", "pattern"])
        .select("leaf", "pattern", "n", "docs", "at.row", "at.line_no")
    )
    wanted = patterns.groupBy("row").agg(F.collect_set("line_no").alias("wanted"))
    line = F.element_at(F.split("text", "\n"), F.col("line_no") + 1)
    texts = (
        rows.select("row", "text")
        .join(wanted, "row")
        .withColumn("line_no", F.explode("wanted"))
        .select("row", "line_no", F.split(normalised(line), " ").alias("tokens"))
        .dropDuplicates(["row", "line_no"])
    )
    literals = F.filter("tokens", lambda token: token != VARIABLE)
    leading = F.filter(F.slice("tokens", 1, DEPTH), lambda token: token != VARIABLE)
    words = materialize(
        patterns.join(texts, ["row", "line_no"]).select(
            "leaf",
            "pattern",
            "n",
            "docs",
            F.size(literals).alias("literals"),
            F.size(leading).alias("leading"),
            F.posexplode("tokens").alias("position", "token"),
        )
    ).where(F.col("position") >= DEPTH)
    return patterns, words


def told_by_words(agree: Column) -> Column:
    """Whether a pattern with so many constant literals after the leading ones is of a template for sure.

    Fields have no say, so rows of numbers and lines that share no more than their leading words are not.
    """
    enough = agree + F.col("leading") >= SIMILARITY * F.col("literals")
    return (agree >= 1) & enough & (2 * F.col("literals") >= F.col("n"))


def template_of_patterns(patterns: DataFrame, words: DataFrame) -> DataFrame:
    """leaf, pattern, joined, told: whether a pattern belongs to the template of its leaf, and whether its
    literals alone tell so."""
    sizes = patterns.groupBy("leaf").agg(F.sum("docs").alias("all_docs"))
    constant = (
        words.groupBy("leaf", "position", "token")
        .agg(F.sum("docs").alias("docs"))
        .join(sizes, "leaf")
        .where("2 * docs > all_docs")
        .select("leaf", "position", "token")
    )
    agree = (
        words.select("leaf", "pattern", "n", "literals", "leading", "position", "token")
        .join(constant, ["leaf", "position", "token"])
        .groupBy("leaf", "pattern", "n", "literals", "leading")
        .agg(F.count("*").alias("agree"), F.count_if(F.col("token") != VARIABLE).alias("agree_literals"))
        .select("leaf", "pattern", "agree", told_by_words(F.col("agree_literals")).alias("told"))
    )
    same = F.coalesce("agree", F.lit(0)) + F.least("n", F.lit(DEPTH))
    return patterns.join(agree, ["leaf", "pattern"], "left").select(
        "leaf",
        "pattern",
        (same >= SIMILARITY * F.col("n")).alias("joined"),
        F.coalesce("told", F.lit(False)).alias("told"),
    )


def frequent_templates(patterns: DataFrame, words: DataFrame, min_docs: int) -> DataFrame:
    """leaf, pattern, template: the templates of tokens that many documents of the leaf have.

    A leaf may hold several templates, none of them with a majority.  At each level, min_docs documents and
    each double of it, the tokens that so many have are constant, and lines with the same constants at the
    same positions are of one template.  Fields with common values are variable on the higher levels.
    """
    frequent = (
        words.groupBy("leaf", "position", "token").agg(F.sum("docs").alias("found")).where(F.col("found") >= min_docs)
    )
    level = F.floor(F.log2(F.col("found") / min_docs) + 1e-9).cast("int")
    is_literal = F.col("token") != VARIABLE
    word = F.struct("position", F.xxhash64("token").alias("token"), level.alias("level"), is_literal.alias("literal"))
    held = (
        words.select("leaf", "pattern", "n", "literals", "leading", "position", "token")
        .join(frequent, ["leaf", "position", "token"])
        .groupBy("leaf", "pattern", "n", "literals", "leading")
        .agg(F.sort_array(F.collect_list(word)).alias("held"))
    )
    levels = held.select("*", F.explode(F.sequence(F.lit(0), F.array_max("held.level"))).alias("level"))
    constant = F.filter("held", lambda word: word["level"] >= F.col("level"))
    same = F.size("constant") + F.least("n", F.lit(DEPTH))
    told = told_by_words(F.size(F.filter("constant", lambda word: word["literal"])))
    of_words = F.transform("constant", lambda word: F.struct(word["position"], word["token"]))
    return (
        levels.select("leaf", "pattern", "n", "literals", "leading", constant.alias("constant"))
        .where((same >= SIMILARITY * F.col("n")) & told)
        .select("leaf", "pattern", F.xxhash64("leaf", of_words).alias("template"))
        .distinct()
    )


def literal_copies(rows: DataFrame, min_docs: int) -> DataFrame:
    """row, line_no of the lines that a smaller document has too, character by character but for blanks."""
    lines = rows.select("row", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", spaced(F.col("line")))
    long = (n_tokens(F.col("line")) >= MIN_TOKENS) | (F.char_length("line") >= LONG)
    least = F.when(F.col("line") == "", 0).when(long, 2).otherwise(min_docs)
    lines = materialize(
        lines.select("row", "doc", "line_no", F.xxhash64("line").alias("literal"), least.alias("least"))
    ).where("least > 0")
    recurring = in_enough_docs(lines, ["literal", "least"], 2).where("docs >= least")
    return (
        lines.join(recurring.select("literal", "first_doc"), "literal")
        .where(F.col("doc") > F.col("first_doc"))
        .select("row", "line_no")
    )


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, every: bool = False) -> DataFrame:
    """row, dropped: the numbers of the lines to drop from each row that has any."""
    rows = keyed(docs)
    lines = materialize(parsed_lines(rows)).where(F.col("n") >= MIN_TOKENS)
    leaves = in_enough_docs(lines, ["leaf"], min_docs).select("leaf")
    lines = materialize(lines.join(leaves, "leaf", "left_semi"))
    patterns, words = pattern_words(rows, lines)
    template = F.when(F.col("joined"), F.lit(None)).otherwise(F.col("pattern"))
    templates = template_of_patterns(patterns, words)
    if every:
        # A pattern of its own has literal copies, or is made of frequent tokens.
        templates = templates.where("joined and told")
    templates = templates.select("leaf", "pattern", F.xxhash64("leaf", template).alias("template"))
    if every:
        templates = materialize(templates.union(frequent_templates(patterns, words, min_docs)))
        of_docs = lines.select("leaf", "pattern", "doc").distinct().join(templates, ["leaf", "pattern"])
        firsts = (
            templates.join(in_enough_docs(of_docs, ["template"], min_docs), "template")
            .groupBy("leaf", "pattern")
            .agg(F.min("first_doc").alias("first_doc"))
        )
        recurring = lines.join(firsts, ["leaf", "pattern"])
    else:
        lines = materialize(
            lines.join(templates, ["leaf", "pattern"]).select("row", "doc", "line_no", "template")
        )
        firsts = in_enough_docs(lines, ["template"], min_docs).select("template", "first_doc")
        recurring = lines.join(firsts, "template")
    dropped = recurring.where(F.col("doc") > F.col("first_doc")).select("row", "line_no")
    if every:
        dropped = dropped.union(literal_copies(rows, min_docs))
    return dropped.groupBy("row").agg(F.collect_set("line_no").alias("dropped"))


def cut(docs: DataFrame, min_docs: int = MIN_DOCS, every: bool = False) -> DataFrame:
    """row, whole, n_lines, n_dropped, kept (the text without its recurring lines) of every document."""
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains("dropped", i))
    dropped = F.col("dropped").isNotNull()
    # Few rows have lines to drop; the others keep their text as it is.
    return (
        keyed(docs)
        .join(recurring_lines(docs, min_docs, every), "row", "left")
        .select(
            "whole",
            F.size(lines).cast("long").alias("n_lines"),
            F.when(dropped, F.size("dropped")).otherwise(0).cast("long").alias("n_dropped"),
            F.when(dropped, F.array_join(left, "\n")).otherwise(F.col("text")).alias("kept"),
        )
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is kept) of every document."""
    return cut(docs.select("doc_id", "text")).select(
        "whole.doc_id", "n_lines", "n_dropped", F.col("kept").alias("text")
    )


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, every: bool = False) -> DataFrame:
    """All columns of all documents of which something is left, recurring lines cut from ``text``."""
    done = cut(docs, min_docs, every).where("n_dropped = 0 or kept rlike '[^ \\\\t\\\\r\\\\n]'")
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("whole.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("kept").cast(kind)).otherwise(F.col("whole.n_chars"))
    return done.select(
        *[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns]
    )


#: The same (without ``every``) in SQL, for tables with one row for each doc_id.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), normed AS (
  SELECT doc_id, line_no,
    regexp_replace(trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '{VARIABLE}', 'g') AS norm
  FROM lines
), parsed AS (
  SELECT doc_id, line_no, norm, string_split(norm, ' ') AS tokens, len(string_split(norm, ' ')) AS n
  FROM normed WHERE norm <> '' AND len(string_split(norm, ' ')) >= {MIN_TOKENS}
), leafed AS (
  SELECT *, concat_ws(' ', n, array_to_string(tokens[1:{DEPTH}], ' ')) AS leaf FROM parsed
), leaves AS (
  SELECT leaf FROM leafed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), open AS (
  SELECT l.* FROM leafed l SEMI JOIN leaves USING (leaf)
), patterns AS (
  SELECT leaf, norm, any_value(tokens) AS tokens, any_value(n) AS n, count(DISTINCT doc_id) AS docs
  FROM open GROUP BY leaf, norm
), words AS (
  SELECT leaf, norm, docs, unnest(generate_series(1, n)) AS position, unnest(tokens) AS token FROM patterns
), sizes AS (
  SELECT leaf, sum(docs) AS all_docs FROM patterns GROUP BY leaf
), constant AS (
  SELECT leaf, position, token FROM words JOIN sizes USING (leaf) WHERE position > {DEPTH}
  GROUP BY leaf, position, token, all_docs HAVING 2 * sum(docs) > all_docs
), agreeing AS (
  SELECT leaf, norm, count(*) AS agree FROM words JOIN constant USING (leaf, position, token) GROUP BY leaf, norm
), placed AS (
  SELECT p.leaf, p.norm,
    CASE WHEN coalesce(agree, 0) + least(n, {DEPTH}) >= {SIMILARITY} * n THEN '' ELSE p.norm END AS own
  FROM patterns p LEFT JOIN agreeing a ON a.leaf = p.leaf AND a.norm = p.norm
), templated AS (
  SELECT o.doc_id, o.line_no, o.leaf, p.own FROM open o JOIN placed p ON p.leaf = o.leaf AND p.norm = o.norm
), recurring AS (
  SELECT leaf, own, min(doc_id) AS first_doc FROM templated
  GROUP BY leaf, own HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), dropped AS (
  SELECT doc_id, line_no FROM templated JOIN recurring USING (leaf, own) WHERE doc_id > first_doc
)
SELECT l.doc_id, count(*) AS n_lines, count(d.line_no) AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE d.line_no IS NULL), '') AS text
FROM lines l LEFT JOIN dropped d ON d.doc_id = l.doc_id AND d.line_no = l.line_no
GROUP BY l.doc_id
"""

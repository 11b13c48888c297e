"""Merkle manifest of a dataset: a tree of digests per source, and one over the sources.

A leaf is the digest of a row.  Every level joins its nodes with themselves: the siblings of a node are the
others of its run of ``arity`` consecutive nodes, and their numbers are its own number with another slot.
Nodes of slot zero then have their whole run and emit its parent.  So each level is equijoins on (tree,
number), hot sources spread over all tasks, and no run or tree is ever collected.

Proofs go back down: a node's path to the root is its own siblings, then its parent's path, which is one
more equijoin a level.  Each level is written to the shared folder; the driver sees the largest tree's size
and the root.

Nodes are numbered in parallel: rows are sorted by ranges, numbered within each range, and shifted by the
number of the tree's rows in the ranges before.

Nulls are written as ``-``, apart from any text.  Rows with one id are leaves of their own, in order of
their digests; a null id comes first.  A null source is a tree of its own.  An empty table gives no rows.
Texts of any length are hashed where they lie and move nowhere.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: each field as its UTF-8 length and value, or ``-``."""

    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[written(v) for v in fields.values()]))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``number``, counting each group's rows from 0 in order, and ``size``, the group's rows.

    Rows of one group, however many, are spread over ranges of (group, order).  Group columns may be null.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*group, *order]]
    place = F.monotonically_increasing_id()
    sorted_rows = (
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_range", F.shiftright(place, 33))
        .withColumn("_at", place)
    )
    dealt = materialize(sorted_rows)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy(*group, "_range")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("size", F.sum("_n").over(Window.partitionBy(*group)))
    )
    renamed = counts.select(*[F.col(c).alias(f"_{c}") for c in [*group, "_range"]], "_first", "_before", "size")
    same = F.col("_range") == F.col("__range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return dealt.join(renamed, same).select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("number"), "size"
    )


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``before`` and ``after``: the digests of the run's other nodes, left to right.

    Nodes are (tree, number, size, digest).  One self-join for each other slot.
    """
    out = nodes
    for shift in range(1, arity):
        # The number with the slot moved on by ``shift``, around the end of the run.
        slot = F.col("number") % arity
        other = F.col("number") - slot + (slot + shift) % arity
        sibling = nodes.select("tree", F.col("number").alias(f"_n{shift}"), F.col("digest").alias(f"_d{shift}"))
        out = out.withColumn(f"_n{shift}", other).join(sibling, ["tree", f"_n{shift}"], "left")
    slot = F.col("number") % arity

    def joined(wanted: Callable[[int], bool]) -> Column:
        """The digests, in order, of the slots whose distance from the own one is wanted."""
        whole = F.lit(None).cast("string")
        for own in range(arity):
            # Slot k is found by the self-join that moves the own slot on to it.
            parts = [F.coalesce(f"_d{(k - own) % arity}", F.lit("")) for k in range(arity) if wanted(k - own)]
            text = F.concat(*parts) if parts else F.lit("")
            whole = F.when(slot == own, text).otherwise(whole)
        return whole

    return out.select(
        *nodes.columns,
        joined(lambda d: d < 0).alias("before"),
        joined(lambda d: d > 0).alias("after"),
    )


def parents(linked: DataFrame, arity: int) -> DataFrame:
    """The next level of nodes: one for each node of slot zero."""
    return linked.where(F.col("number") % arity == 0).select(
        "tree",
        F.floor(F.col("number") / arity).alias("number"),
        F.ceil(F.col("size") / arity).alias("size"),
        digest(F.concat("digest", "after")).alias("digest"),
    )


class Forest:
    """All levels of the trees over leaves (tree, number, size, digest)."""

    def __init__(self, leaves: DataFrame, arity: int = ARITY):
        self.arity = arity
        self.levels: list[DataFrame] = []
        self.tops: list[DataFrame] = []
        nodes = materialize(leaves)
        most = nodes.agg(F.max("size")).first()[0] or 0
        while most:
            self.tops.append(nodes.where("size = 1").select("tree", "digest"))
            if most == 1:
                break
            linked = materialize(with_siblings(nodes.where("size > 1"), arity))
            self.levels.append(linked)
            nodes, most = parents(linked, arity), -(-most // arity)

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        out = self.tops[0]
        for top in self.tops[1:]:
            out = out.unionByName(top)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """(tree, number, path) of every leaf: its siblings level by level, then the tree's path in
        ``above`` (tree, path)."""
        reached = self._ended(len(self.tops) - 1, above)
        for k in range(len(self.levels) - 1, -1, -1):
            own = self.levels[k].select(
                "tree",
                "number",
                F.floor(F.col("number") / self.arity).alias("_parent"),
                F.struct("before", "after").alias("_own"),
            )
            parent = reached.select("tree", F.col("number").alias("_parent"), "path")
            below = own.join(parent, ["tree", "_parent"]).select(
                "tree", "number", F.concat(F.array("_own"), F.col("path")).alias("path")
            )
            ended = self._ended(k, above)
            reached = below.unionByName(ended)
            if k:
                reached = materialize(reached)
        return reached

    def _ended(self, k: int, above: DataFrame) -> DataFrame:
        """The tops of the trees that end at level ``k``, with the path from there on."""
        top = self.tops[k].select("tree", F.lit(0).cast("long").alias("number"))
        return top.join(above, "tree").select("tree", "number", "path")


def folded(start: Column, path: Column) -> Column:
    """The digest at the end of a path."""
    return F.aggregate(path, start, lambda acc, step: digest(F.concat(step["before"], acc, step["after"])))


def proof(path: Column) -> Column:
    """The siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(leaves: DataFrame, group: str = "source", arity: int = ARITY) -> DataFrame:
    """Add ``subroot``, ``root`` and ``path`` to rows that have a group, ``doc_id`` and ``leaf``.

    ``path`` lists, from the leaf to the root, the siblings before and after; ``folded`` checks it.
    """
    placed = numbered(leaves, [group], ["doc_id", "leaf"])
    trees = numbered(placed.select(group).distinct(), [], [group]).select(
        F.col(group).alias("_group"), F.col("number").alias("tree"), F.col("size").alias("trees")
    )
    rows = materialize(
        placed.join(trees, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    )
    sources = Forest(rows.select("tree", "number", "size", F.col("leaf").alias("digest")), arity)
    if not sources.tops:
        empty = leaves.withColumn("subroot", F.lit(None).cast("string"))
        return empty.withColumn("root", F.lit(None).cast("string")).withColumn("path", F.lit(None).cast(PATH))
    subroots = materialize(sources.roots())
    sizes = rows.select("tree", "trees").distinct()
    top = Forest(
        subroots.join(sizes, "tree").select(
            F.lit(0).cast("long").alias("tree"),
            F.col("tree").alias("number"),
            F.col("trees").alias("size"),
            "digest",
        ),
        arity,
    )
    nothing = top.roots().select("tree", F.array().cast(PATH).alias("path"))
    above = materialize(top.paths(nothing).select(F.col("number").alias("tree"), "path"))
    root = top.roots().first()["digest"]
    return (
        rows.join(sources.paths(above), ["tree", "number"])
        .join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
        .select(*leaves.columns, "subroot", F.lit(root).alias("root"), "path")
    )


def verified(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """The manifest of documents, and what the proof of each row gives for its copy.

    The copy of every second row, by the CRC of its decimal id, has lost the line breaks of its text; rows
    without an id have a true copy.
    """
    fields = {name: F.col(name) for name in FIELDS}
    copied = fields | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    own = leaf(fields)
    leaves = docs.select("doc_id", "source", own.alias("leaf"), F.when(tampered, leaf(copied)).alias("copy"))
    out = manifest(leaves, "source", arity).withColumn(
        "folded_root", folded(F.coalesce("copy", "leaf"), F.col("path"))
    )
    return out.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        digest(proof(F.col("path"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The same in SQL, for arity 3.  CRC-32 by its byte table; a walk collects each leaf's siblings.
SQL = """
WITH RECURSIVE crc AS (
  SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FOR i IN range(256)] AS t
), fields AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    replace(text, chr(10), '') AS cut,
    xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS h
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN h % 2 = 0 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) END AS copy
  FROM fields
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, copy) - 1 AS number
  FROM leaves
), tree AS (
  SELECT 0 AS level, source, number, leaf AS digest, count(*) OVER (PARTITION BY source) AS size FROM placed
  UNION ALL
  SELECT level + 1, source, number // 3, sha256(string_agg(digest, '' ORDER BY number)), any_value((size + 2) // 3)
  FROM tree WHERE size > 1 GROUP BY level, source, number // 3
), runs AS MATERIALIZED (
  SELECT level, source, number // 3 AS run, list(digest ORDER BY number) AS d
  FROM tree WHERE size > 1 GROUP BY level, source, number // 3
), subroots AS MATERIALIZED (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS number,
    count(*) OVER () AS size
  FROM tree WHERE size = 1
), top AS (
  SELECT 0 AS level, number, subroot AS digest, size FROM subroots
  UNION ALL
  SELECT level + 1, number // 3, sha256(string_agg(digest, '' ORDER BY number)), any_value((size + 2) // 3)
  FROM top WHERE size > 1 GROUP BY level, number // 3
), top_runs AS MATERIALIZED (
  SELECT level, number // 3 AS run, list(digest ORDER BY number) AS d
  FROM top WHERE size > 1 GROUP BY level, number // 3
), walk AS (
  SELECT 0 AS level, source, number AS leaf_number, number, '' AS proof, coalesce(copy, leaf) AS fold FROM placed
  UNION ALL
  SELECT w.level + 1, w.source, leaf_number, number // 3,
    proof || array_to_string(d[:number % 3], '') || array_to_string(d[number % 3 + 2:], ''),
    sha256(array_to_string(d[:number % 3], '') || fold || array_to_string(d[number % 3 + 2:], ''))
  FROM walk w JOIN runs r
    ON r.level = w.level AND r.source IS NOT DISTINCT FROM w.source AND r.run = w.number // 3
), ended AS (
  SELECT source, leaf_number, arg_max(proof, level) AS proof, arg_max(fold, level) AS fold
  FROM walk GROUP BY source, leaf_number
), on_top AS (
  SELECT 0 AS level, e.source, leaf_number, s.number, proof, fold, subroot
  FROM ended e JOIN subroots s ON s.source IS NOT DISTINCT FROM e.source
  UNION ALL
  SELECT w.level + 1, source, leaf_number, number // 3,
    proof || array_to_string(d[:number % 3], '') || array_to_string(d[number % 3 + 2:], ''),
    sha256(array_to_string(d[:number % 3], '') || fold || array_to_string(d[number % 3 + 2:], '')), subroot
  FROM on_top w JOIN top_runs r ON r.level = w.level AND r.run = w.number // 3
), done AS (
  SELECT source, leaf_number, any_value(subroot) AS subroot, arg_max(proof, level) AS proof,
    arg_max(fold, level) AS fold
  FROM on_top GROUP BY source, leaf_number
), root AS (SELECT digest AS root FROM top WHERE size = 1)
SELECT p.doc_id, p.leaf, d.subroot, root.root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root,
  d.fold = root.root AS verified
FROM placed p JOIN done d ON d.source IS NOT DISTINCT FROM p.source AND d.leaf_number = p.number, root
"""

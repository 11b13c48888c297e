"""Hierarchical product dimension: lookup, ancestor chains and composed text.

Taxonomy: code, description, section, parent, level.  Sections: section, name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .requests import leaf_codes


def latest_entries(rows: DataFrame, seq: str) -> DataFrame:
    """One row per code: the last one read wins."""
    columns = [c for c in rows.columns if c not in ("code", seq)]
    return (
        rows.groupBy("code")
        .agg(F.max_by(F.struct(*columns), seq).alias("_row"))
        .select("code", "_row.*")
    )


def lookup(keys: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Point lookup of any level; an unknown code keeps its row with nulls."""
    return keys.join(taxonomy, "code", "left")


def parent_paths(taxonomy: DataFrame) -> DataFrame:
    """For every node that is a parent: the chain from itself up to its root.

    Only inner nodes walk, which are few next to the leaves.  ``path`` is an array of struct
    (code, description), nearest first.  A chain stops at a missing parent or when it would meet a
    code again.  Every round appends the chain found so far of the node a chain has come to, so the
    number of rounds grows with the logarithm of the depth; each round is written once.
    """
    walk = materialize(
        taxonomy.join(
            taxonomy.select(F.col("parent").alias("code")).distinct(), "code", "left_semi"
        ).select(
            "code",
            F.array(F.struct("code", "description")).alias("path"),
            F.col("parent").alias("_next"),
        )
    )
    seen = F.transform("path", lambda p: p["code"])
    # What lies before the first code that the chain has already.
    repeat = F.transform("_more", lambda p: F.array_contains("_seen", p["code"]))
    n_fresh = F.coalesce(
        F.nullif(F.array_position(repeat, F.lit(True)), F.lit(0)) - 1, F.size("_more")
    ).cast("int")
    while not walk.filter("_next IS NOT NULL").isEmpty():
        up = walk.select(
            F.col("code").alias("_up"), F.col("path").alias("_more"), F.col("_next").alias("_after")
        )
        joined = (
            walk.join(up, F.col("_next") == F.col("_up"), "left")
            .withColumn("_seen", seen)
            .withColumn("_fresh", n_fresh)
        )
        grown = F.concat("path", F.slice("_more", F.lit(1), F.col("_fresh")))
        walk = materialize(
            joined.select(
                "code",
                F.when(F.col("_up").isNotNull(), grown).otherwise(F.col("path")).alias("path"),
                F.when(F.col("_fresh") == F.size("_more"), F.col("_after")).alias("_next"),
            )
        )
    return walk.select("code", "path")


def ancestors(taxonomy: DataFrame) -> DataFrame:
    """Every node with ``path``: its ancestors, nearest first, never the node itself."""
    chains = parent_paths(taxonomy).select(
        F.col("code").alias("parent"), F.col("path").alias("_chain")
    )
    # In a cycle the chain comes back to the node: keep what lies before it.
    at_self = F.array_position(F.transform("_chain", lambda p: p["code"]), F.col("code"))
    chain = F.coalesce("_chain", F.array().cast("array<struct<code:string,description:string>>"))
    path = F.when(at_self > 0, F.slice(chain, 1, (at_self - 1).cast("int"))).otherwise(chain)
    return taxonomy.join(chains, "parent", "left").select(*taxonomy.columns, path.alias("path"))


def taxonomy_text(taxonomy: DataFrame, sections: DataFrame) -> DataFrame:
    """Leaf codes with their composed text: code line, parents from the root down, section line."""
    chained = leaf_codes(ancestors(taxonomy)).join(
        sections.select("section", F.col("name").alias("_name")), "section", "left"
    )
    # Wording of the three lines.
    first = F.concat(F.lit("HS "), F.col("code"), F.lit(": "), F.col("description"))
    parents = F.when(
        F.size("path") > 0,
        F.concat(
            F.lit("Parent headings: "),
            F.array_join(F.reverse(F.transform("path", lambda p: p["description"])), " > "),
        ),
    )
    section = F.when(
        F.length("_name") > 0,
        F.concat(
            F.lit("HS Section "),
            F.col("section"),
            F.lit(": "),
            F.upper(F.substring("_name", 1, 1)),
            F.expr("substring(_name, 2)"),
        ),
    )
    return chained.select(
        "code", "description", F.concat_ws("\n", first, parents, section).alias("taxonomy_text")
    )

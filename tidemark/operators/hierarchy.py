"""Interval labels of a tree: everything below a node is one range, everything above it another.

A walk around the tree enters and leaves every node once.  Each step knows the next one: from entering a
node to its first child, or to leaving it; from leaving it to its next sibling, or to leaving the parent.
That makes one linked list of all steps, which is ranked by pointer jumping: each round, every step skips
to where its next one leads and adds up the way, so rounds grow with the logarithm of the list, whatever
the depth of the tree, and no path is ever held.  Steps on a cycle never come to the end.

Rows: code, parent, one per code.  A parent that is null or no code itself makes its node a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranges import running


def _steps(tree: DataFrame) -> DataFrame:
    """(step, next): steps 2n and 2n + 1 enter and leave the node of number n; the last one has no next."""
    codes = materialize(running(tree.select("code", "parent"), [], ["code"]))
    ids = codes.select(F.col("code").alias("_code"), F.col("number").alias("up"))
    known = codes.join(ids, F.col("parent") == F.col("_code"), "left").select(
        F.col("number").alias("id"), "up"
    )
    # Children of a node by their place, which a node with a third of all children spreads over ranges.
    placed = materialize(running(known, ["up"], ["id"]))
    sibling = placed.select(
        F.col("up").alias("_up"), (F.col("number") - 1).alias("_number"), F.col("id").alias("after")
    )
    with_next = placed.join(
        sibling, F.col("up").eqNullSafe(F.col("_up")) & (F.col("number") == F.col("_number")), "left"
    )
    first = placed.filter("number = 0 and up is not null").select(
        F.col("up").alias("_parent"), F.col("id").alias("child")
    )
    both = with_next.join(first, F.col("id") == F.col("_parent"), "left")
    return both.select(
        F.explode(
            F.array(
                F.struct(
                    (F.col("id") * 2).alias("step"),
                    F.coalesce(F.col("child") * 2, F.col("id") * 2 + 1).alias("next"),
                ),
                F.struct(
                    (F.col("id") * 2 + 1).alias("step"),
                    F.coalesce(F.col("after") * 2, F.col("up") * 2 + 1).alias("next"),
                ),
            )
        ).alias("s")
    ).select("s.step", "s.next")


def _ranked(steps: DataFrame) -> DataFrame:
    """(step, left): steps to the end of the list; none for steps that never come to it."""
    way = materialize(steps.withColumn("left", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")))
    open_steps = way.filter("next is not null").count()
    rounds = max(1, open_steps).bit_length() + 1
    for _ in range(rounds):
        if not open_steps:
            break
        ahead = way.select(F.col("step").alias("_step"), F.col("next").alias("_next"), F.col("left").alias("_left"))
        way = materialize(
            way.join(ahead, F.col("next") == F.col("_step"), "left").select(
                "step", F.col("_next").alias("next"), (F.col("left") + F.coalesce("_left", F.lit(0))).alias("left")
            )
        )
        open_steps = way.filter("next is not null").count()
    return way.filter("next is null").select("step", "left")


def label(tree: DataFrame) -> DataFrame:
    """(code, enter, leave) of every node: u lies below v where v.enter < u.enter and u.leave < v.leave.

    Nodes on a cycle, and all below them, have null labels.
    """
    ranked = _ranked(materialize(_steps(tree)))
    most = ranked.agg(F.max("left")).first()[0] or 0
    number = materialize(running(tree.select("code"), [], ["code"]))
    at = ranked.select(
        F.floor(F.col("step") / 2).alias("id"),
        (F.col("step") % 2 == 0).alias("enters"),
        (F.lit(most) - F.col("left")).alias("place"),
    ).groupBy("id").agg(
        F.max(F.when(F.col("enters"), F.col("place"))).alias("enter"),
        F.max(F.when(~F.col("enters"), F.col("place"))).alias("leave"),
    )
    found = number.join(at, F.col("number") == F.col("id"), "left")
    whole = F.col("enter").isNotNull() & F.col("leave").isNotNull()
    return found.select(
        "code", F.when(whole, F.col("enter")).alias("enter"), F.when(whole, F.col("leave")).alias("leave")
    )


def cycles(labels: DataFrame) -> DataFrame:
    """Codes that are on a cycle or hang on one."""
    return labels.filter("enter is null").select("code")


def below(labels: DataFrame, code: str) -> DataFrame:
    """The codes below a code: one range of labels."""
    node = labels.filter(F.col("code") == code).select("enter", "leave")
    enter, leave = node.select("enter").scalar(), node.select("leave").scalar()
    return labels.filter((F.col("enter") > enter) & (F.col("leave") < leave)).select("code")


def above(labels: DataFrame, code: str) -> DataFrame:
    """The codes above a code, the root first."""
    node = labels.filter(F.col("code") == code).select("enter", "leave")
    enter, leave = node.select("enter").scalar(), node.select("leave").scalar()
    return labels.filter((F.col("enter") < enter) & (F.col("leave") > leave)).orderBy("enter").select("code")


def totals_below(labels: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(code, columns): sums of ``values`` (code, columns) over each node and everything below it.

    One running total over the walk: what lies between entering and leaving a node is below it.  Nodes
    without labels have null sums.
    """
    own = labels.join(values, "code", "left").select(
        "code", "enter", "leave", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]
    )
    enters = F.struct(F.col("enter").alias("place"), F.lit(True).alias("enters"))
    leaves = F.struct(F.col("leave").alias("place"), F.lit(False).alias("enters"))
    steps = own.filter("enter is not null").select("code", *columns, F.explode(F.array(enters, leaves)).alias("s"))
    walk = steps.select(
        "code", "s.place", "s.enters", *[F.when(F.col("s.enters"), F.col(c)).otherwise(0).alias(c) for c in columns]
    )
    so_far = materialize(running(walk, [], ["place"], {f"_{c}": c for c in columns}))
    sums = so_far.groupBy("code").agg(
        *[
            (
                F.max(F.when(~F.col("enters"), F.col(f"_{c}"))) - F.max(F.when(F.col("enters"), F.col(f"_{c}")))
            ).alias(c)
            for c in columns
        ]
    )
    return own.select("code").join(sums, "code", "left")

"""Numbers and running totals over sorted rows, spread over ranges: no group is ever one task.

Rows are dealt into ranges of (group, order) and numbered within each; a table with one row per group and
range gives what comes before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running(
    rows: DataFrame, group: list[str], order: list[str], totals: dict[str, str] | None = None
) -> DataFrame:
    """Add ``number``, counting each group's rows from 0 in order, and for each entry (name: column) of
    ``totals`` the sum of the column over the rows before.  ``order`` must be unique within a group."""
    totals = totals or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*group, *order]]
    dealt = materialize(
        rows.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id())
    )
    within = Window.partitionBy(*group, "_range").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    sums = {name: F.coalesce(F.sum(column).over(so_far), F.lit(0)) for name, column in totals.items()}
    numbered = dealt.withColumn("number", (F.row_number().over(within) - 1).cast("long")).withColumns(sums)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy(*group, "_range").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()]
    )
    shifts = shares.select(
        *[F.col(c).alias(f"_own_{c}") for c in [*group, "_range"]],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_shift_{n}") for n in totals],
    )
    same = F.col("_range") == F.col("_own__range")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_own_{c}"))
    return numbered.join(shifts, same).select(
        *rows.columns,
        (F.col("number") + F.col("_shift")).alias("number"),
        *[(F.col(n) + F.col(f"_shift_{n}")).alias(n) for n in totals],
    )

"""Trade cells kept in a store that is refreshed load by load.

A cell holds, for one item, flow, year and partner, what its records say in a form that can be merged: the
last value and the first name with their places, whether any record is provisional, and how many there are.
So cells of a load that arrives in parts are merged, not computed again.

The store is a folder of versions and a log of commits.  A refresh replaces the cells of the loads that are
due: it reads the (flow, year) partitions with a due load and no other, writes them under a new version, and
then commits a list of which version counts for which partition.  Commits are numbered, and writing one that
exists fails: of two refreshes from the same state, the second one loses and can be run again.  A refresh
that dies before its commit leaves files that nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAD = ["item_code", "flow", "year"]
CELL = [*LOAD, "partner_code"]


class Conflict(RuntimeError):
    """Another refresh has committed in the meantime; run this one again."""


def cell_states(records: DataFrame) -> DataFrame:
    """Mergeable cells of records (item_code, flow, year, partner_code, partner_name, value,
    is_provisional, seq)."""
    return records.groupBy(*CELL).agg(
        F.max(F.struct("seq", "value")).alias("last"),
        F.min(F.when(F.col("partner_name").isNotNull(), F.struct("seq", "partner_name"))).alias("first"),
        F.bool_or("is_provisional").alias("is_provisional"),
        F.count(F.lit(1)).alias("n"),
    )


def merge_states(*parts: DataFrame) -> DataFrame:
    """The cells of all records that went into the parts."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*CELL).agg(
        F.max("last").alias("last"),
        F.min("first").alias("first"),
        F.bool_or("is_provisional").alias("is_provisional"),
        F.sum("n").alias("n"),
    )


def values(states: DataFrame) -> DataFrame:
    """Cells as plain columns: value, partner_name, is_provisional, n."""
    return states.select(
        *CELL,
        F.col("last.value").alias("value"),
        F.col("first.partner_name").alias("partner_name"),
        "is_provisional",
        "n",
    )


class CellStore:
    """Cells below ``path``; ``schema`` is that of ``cell_states``."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:  # noqa: ANN001
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def head(self) -> tuple[int, list]:
        """The last commit's number, and its rows (flow, year, version): one for each partition, that is
        for each flow and calendar year."""
        try:
            log = self.spark.read.parquet(f"{self.path}/commits")
        except AnalysisException:
            return 0, []
        last = log.agg(F.max("commit")).first()[0] or 0
        own = log.filter((F.col("commit") == last) & F.col("version").isNotNull())
        return last, own.select("flow", "year", "version").collect()

    def _folder(self, row) -> str:  # noqa: ANN001
        return f"{self.path}/cells/version={row.version}/flow={row.flow}/year={row.year}"

    def _read(self, rows: list) -> DataFrame:
        """The cells of the given partitions; nothing else is listed or read."""
        if not rows:
            return self.spark.createDataFrame([], self.schema)
        base = self.spark.read.option("basePath", f"{self.path}/cells").parquet(*map(self._folder, rows))
        return base.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])

    def read(self) -> DataFrame:
        return self._read(self.head()[1])

    def refresh(self, due: DataFrame, states: DataFrame) -> list[tuple[str, int]]:
        """Replace the cells of the loads ``due`` (item_code, flow, year) by ``states``; loads that have no
        cells any more vanish.  Returns the partitions that were written."""
        number, rows = self.head()
        # At most one row for each flow and year of the calendar.
        touched = {(r.flow, r.year) for r in due.select("flow", "year").distinct().collect()}
        old = self._read([r for r in rows if (r.flow, r.year) in touched])
        loads = due.select(*LOAD).distinct()
        kept = old.join(loads, LOAD, "left_anti")
        new = kept.unionByName(states.join(loads, LOAD, "left_semi").select(*kept.columns))
        version = uuid.uuid4().hex
        (
            new.repartition("flow", "year", F.pmod(F.xxhash64("item_code"), F.lit(16)))
            .sortWithinPartitions("item_code", "partner_code")
            .write.partitionBy("flow", "year")
            .parquet(f"{self.path}/cells/version={version}")
        )
        written = (
            self.spark.read.parquet(f"{self.path}/cells/version={version}").select("flow", "year").distinct().collect()
            if not new.isEmpty()
            else []
        )
        after = [(r.flow, r.year, r.version) for r in rows if (r.flow, r.year) not in touched]
        after += [(r.flow, int(r.year), version) for r in written]
        self._commit(number + 1, after)
        return sorted(touched)

    def _commit(self, number: int, rows: list[tuple]) -> None:
        # A row of nulls, so that a commit without any partition is one too.
        schema = "flow string, year int, version string"
        log = self.spark.createDataFrame([*rows, (None, None, None)], schema).coalesce(1)
        try:
            log.write.mode("errorifexists").parquet(f"{self.path}/commits/commit={number}")
        except AnalysisException as error:
            raise Conflict(f"commit {number} exists") from error

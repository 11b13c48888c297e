"""Call quotas over any log: threads may run over days and tenants.

Caps hold per thread (for ever), per (tenant, day) and per day; a refused call counts nowhere.  Whether a
call is admitted thus depends on earlier calls of all its scopes, and these on others again.  Instead of
walking the log, every round bounds the truth from both sides:

* If all undecided calls counted, every scope would fill up at the earliest.  A call that comes before that
  moment in all its scopes is surely admitted.
* If of a scope's calls only those counted that are early enough in their two *other* scopes, it would fill
  up at the latest.  A call after that moment in any of its scopes is surely refused.

Decided calls leave, the admitted ones use up their scopes, and the next round sees the rest.  The earliest
undecided call is first in all its scopes and is always decided, and so is, in one round, the undecided
prefix of every scope; there is no loop over days.  Rounds end when no call is left.

A scope takes part with its first calls only, as many as its cap, which Spark cuts out before the shuffle:
no thread, tenant or day is ever sorted or collected as a whole.  Each round is written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .logs import DAY_CAP, DECISION, THREAD_CAP

SCOPES = {"thread": ["thread_id"], "tenant": ["tenant_id", "day"], "day": ["day"]}
CALL = ("ts_us", "call_id")
COLUMNS = ["call_id", "ts_us", "day", "thread_id", "tenant_id"]


@dataclass
class Caps:
    thread: int = THREAD_CAP
    tenant: int = DAY_CAP
    day: int = DAY_CAP

    def of(self, scope: str) -> int:
        return getattr(self, scope)


@dataclass
class Report:
    """What a run of ``admit`` did: calls undecided before each round."""

    undecided: list[int] = field(default_factory=list)


def _call() -> Column:
    return F.struct(*CALL)


def _filled(calls: DataFrame, scope: str, cap: int) -> DataFrame:
    """The call with which each scope is full, where it gets full: (scope columns, <scope>_at)."""
    keys = SCOPES[scope]
    order = Window.partitionBy(*keys).orderBy(*CALL)
    return (
        calls.select(*keys, *CALL, f"{scope}_left")
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= cap)  # cut down before the shuffle
        .filter(F.col("position") == F.col(f"{scope}_left"))
        .select(*keys, _call().alias(f"{scope}_at"))
    )


def _with_cutoffs(calls: DataFrame, cutoffs: dict[str, DataFrame]) -> DataFrame:
    for scope, found in cutoffs.items():
        calls = calls.join(found, SCOPES[scope], "left")
    return calls


def _in_time(scope: str) -> Column:
    """Whether a call comes no later than the one with which its scope is full."""
    return F.col(f"{scope}_at").isNull() | (_call() <= F.col(f"{scope}_at"))


def _round(calls: DataFrame, caps: Caps) -> DataFrame:
    """The undecided calls with ``admitted``: true, false, or null for those that stay undecided."""
    earliest = _with_cutoffs(calls, {s: _filled(calls, s, caps.of(s)) for s in SCOPES})
    flagged = materialize(
        earliest.select(*calls.columns, *[_in_time(s).alias(f"{s}_early") for s in SCOPES])
    )
    latest = {}
    for scope in SCOPES:
        others = [F.col(f"{s}_early") for s in SCOPES if s != scope]
        latest[scope] = _filled(flagged.filter(others[0] & others[1]), scope, caps.of(scope))
    early = F.col("thread_early") & F.col("tenant_early") & F.col("day_early")
    late = ~(_in_time("thread") & _in_time("tenant") & _in_time("day"))
    admitted = F.when(early, F.lit(True)).when(late, F.lit(False))
    return _with_cutoffs(flagged, latest).select(*calls.columns, admitted.alias("admitted"))


def _used(admitted: DataFrame, scope: str) -> DataFrame:
    return admitted.groupBy(*SCOPES[scope]).agg(F.count(F.lit(1)).alias(f"{scope}_now"))


def admit(
    log: DataFrame,
    caps: Caps | None = None,
    used: dict[str, DataFrame] | None = None,
    report: Report | None = None,
) -> DataFrame:
    """Calls (…, call_id, ts_us, day, thread_id, tenant_id) with ``decision``: ADMITTED, or the first cap
    (thread, tenant, day) that was used up when the call came.

    Calls count in order of time, then id, which together must be unique.  ``used`` has for a scope its
    columns and ``n_used``, what calls before this log have used up.  A null thread or tenant has no cap of
    its own.
    """
    caps = caps or Caps()
    calls = log.select(*COLUMNS)
    for scope, keys in SCOPES.items():
        before = F.lit(0)
        if used and scope in used:
            calls = calls.join(used[scope].select(*keys, "n_used"), keys, "left")
            before = F.coalesce("n_used", F.lit(0))
        calls = calls.withColumn(f"{scope}_left", F.lit(caps.of(scope)) - before).drop("n_used")
    lefts = [f"{s}_left" for s in SCOPES]
    start = materialize(calls)
    undecided = start
    admitted: list[DataFrame] = []
    while True:
        undecided = undecided.filter(" and ".join(f"{name} > 0" for name in lefts))
        n = undecided.count()
        if report is not None:
            report.undecided.append(n)
        if not n:
            break
        done = materialize(_round(undecided, caps))
        newly = done.filter("admitted")
        admitted.append(newly.select(*COLUMNS))
        rest = done.filter("admitted is null").drop("admitted")
        for scope, keys in SCOPES.items():
            rest = rest.join(_used(newly, scope), keys, "left").withColumn(
                f"{scope}_left", F.col(f"{scope}_left") - F.coalesce(f"{scope}_now", F.lit(0))
            ).drop(f"{scope}_now")
        undecided = materialize(rest.select(*start.columns))
    return _decided(log, start, admitted)


def _decided(log: DataFrame, start: DataFrame, admitted: list[DataFrame]) -> DataFrame:
    """Decisions from the last admitted call of each scope that is used up."""
    every = reduce(DataFrame.unionByName, admitted, start.select(*COLUMNS).filter(F.lit(False)))
    out = log
    for scope, keys in SCOPES.items():
        left = start.groupBy(*keys).agg(F.min(f"{scope}_left").alias("left"))
        counted = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(_call()).alias("last"))
        full = (
            left.join(counted, keys, "left")
            .filter(F.coalesce("n", F.lit(0)) >= F.col("left"))
            .select(*keys, F.lit(True).alias(f"{scope}_full"), F.col("last").alias(f"{scope}_at"))
        )
        out = out.join(full, keys, "left")

    def over(scope: str) -> Column:
        at = F.col(f"{scope}_at")
        return F.col(f"{scope}_full") & (at.isNull() | (_call() > at))

    decision = F.lit("ADMITTED")
    for scope in reversed(SCOPES):
        decision = F.when(over(scope), F.lit(DECISION[scope])).otherwise(decision)
    return out.select(*log.columns, decision.alias("decision"))


def usage(decided: DataFrame) -> dict[str, DataFrame]:
    """What the admitted calls have used up, by scope, as ``admit`` takes it."""
    admitted = decided.filter("decision = 'ADMITTED'")
    return {
        scope: admitted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used"))
        for scope, keys in SCOPES.items()
    }

"""Quota rounds: decisions typed by hand, and what must hold for any log."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from tidemark.operators import quotas as Q
from tidemark.streaming import ledger

LOG = "call_id long, ts timestamp, ts_us long, day date, thread_id string, tenant_id string"
START = datetime(2024, 1, 1)


def frame(spark, rows):
    """rows are (thread, tenant, hours after the start), in order of their ids."""
    out = []
    for i, (thread, tenant, hours) in enumerate(rows):
        at = START + timedelta(hours=hours)
        out.append((i, at, int((at - datetime(1970, 1, 1)).total_seconds() * 1e6), at.date(), thread, tenant))
    return spark.createDataFrame(out, LOG)


def decisions(decided) -> list[str]:
    return [r.decision for r in sorted(decided.collect(), key=lambda r: r.call_id)]


A, T, N, D = "ADMITTED", "THREAD_CAP", "TENANT_DAY_CAP", "DAY_CAP"

BY_HAND = [
    # a thread keeps its count over midnight
    (Q.Caps(2, 9, 9), [("x", "a", 1), ("x", "a", 2), ("x", "a", 25), ("y", "a", 26)], [A, A, T, A]),
    # a refused call counts nowhere: x is refused by its tenant on day one and still has both its calls
    (Q.Caps(2, 1, 9), [("y", "a", 1), ("x", "a", 2), ("x", "a", 3), ("x", "b", 4), ("x", "a", 25), ("x", "b", 26)], [A, N, N, A, A, T]),
    # one thread under two tenants
    (Q.Caps(9, 1, 9), [("x", "a", 1), ("x", "b", 2), ("x", "a", 3), ("x", "b", 4)], [A, A, N, N]),
    # the day is full for all tenants; the next day is not
    (Q.Caps(9, 2, 3), [("x", "a", 1), ("y", "a", 2), ("z", "b", 3), ("u", "b", 4), ("v", "c", 5), ("u", "b", 24)], [A, A, A, D, D, A]),
    # the first of several reasons is named
    (Q.Caps(1, 1, 1), [("x", "a", 1), ("x", "a", 2), ("y", "a", 3), ("y", "b", 4)], [A, T, N, D]),
    (Q.Caps(0, 1, 1), [("x", "a", 1)], [T]),
    # without a thread or tenant that cap does not hold
    (Q.Caps(1, 1, 3), [(None, "a", 1), (None, "b", 2), ("x", None, 3), ("y", None, 4)], [A, A, A, D]),
    (Q.Caps(1, 1, 1), [], []),
]


@pytest.mark.parametrize(("caps", "rows", "expect"), BY_HAND)
def test_by_hand(spark, caps, rows, expect):
    assert decisions(Q.admit(frame(spark, rows), caps)) == expect


def crossing_log(seed: int, n: int = 700, days: int = 6) -> list[tuple]:
    draw = random.Random(seed)
    hours = sorted(draw.uniform(0, 24 * days) for _ in range(n))
    return [(draw.choice("pqrstuvw"), draw.choices("abc", [6, 2, 1])[0], h) for h in hours]


def check(rows: list[tuple], caps: Q.Caps, decided: list[str]) -> None:
    """A call is admitted if and only if none of its scopes had used up its cap before it, and the reason is
    the first scope that had."""
    admitted = [{"thread": Counter(), "tenant": Counter(), "day": Counter()}]
    for (thread, tenant, hours), decision in zip(rows, decided, strict=True):
        day = int(hours // 24)
        own = {"thread": thread, "tenant": (tenant, day), "day": day}
        spent = [scope for scope in own if admitted[0][scope][own[scope]] >= caps.of(scope)]
        assert decision == ({"thread": T, "tenant": N, "day": D}[spent[0]] if spent else A)
        if decision == A:
            for scope, key in own.items():
                admitted[0][scope][key] += 1


@pytest.mark.parametrize(("seed", "caps"), [(1, Q.Caps(40, 30, 45)), (2, Q.Caps(40, 1000, 60)), (3, Q.Caps(60, 60, 90))])
def test_every_decision_follows_from_those_before(spark, seed, caps):
    rows, report = crossing_log(seed), Q.Report()
    decided = decisions(Q.admit(frame(spark, rows), caps, report=report))
    check(rows, caps, decided)
    assert len(set(decided)) >= 3
    assert len(report.undecided) < 25 and report.undecided[-1] == 0


def test_without_the_refused_calls_nothing_changes(spark):
    rows, caps = crossing_log(4, 400), Q.Caps(30, 25, 40)
    decided = decisions(Q.admit(frame(spark, rows), caps))
    kept = [row for row, decision in zip(rows, decided, strict=True) if decision == A]
    assert set(decisions(Q.admit(frame(spark, kept), caps))) == {A}


def test_usage_carries_a_log_over_its_parts(spark):
    rows, caps = crossing_log(5, 500), Q.Caps(35, 20, 30)
    whole = frame(spark, rows)
    first = Q.admit(whole.filter("call_id < 230"), caps)
    second = Q.admit(whole.filter("call_id >= 230"), caps, Q.usage(first))
    assert decisions(first) + decisions(second) == decisions(Q.admit(whole, caps))


def run_stream(spark, log, folder, write, sizes):
    """Feed the log in batches of the given sizes through ``foreachBatch``, in two runs."""
    rows, at = log.collect(), 0
    for i, size in enumerate(sizes):
        part = spark.createDataFrame(rows[at : at + size], log.schema)
        part.coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
        at += size
        if i in (len(sizes) // 2, len(sizes) - 1):
            reader = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
            started = (
                reader.option("recursiveFileLookup", True)
                .parquet(f"{folder}/in")
                .writeStream.foreachBatch(write)
                .option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            started.awaitTermination(300)
    assert at >= len(rows)


def test_quota_stream_equals_batch(spark, tmp_path):
    rows, caps = crossing_log(6, 400, days=4), Q.Caps(45, 30, 40)
    log = frame(spark, rows)
    write = ledger.quota_writer(str(tmp_path / "out"), caps, compact_every=2)
    run_stream(spark, log, str(tmp_path), write, [120, 3, 90, 120, 67])
    got = spark.read.parquet(str(tmp_path / "out" / "decisions"))
    assert decisions(got) == decisions(Q.admit(log, caps))


def test_late_and_replayed_calls(spark, tmp_path):
    caps = Q.Caps(9, 2, 9)
    write = ledger.quota_writer(str(tmp_path), caps, keep_days=1, compact_every=1)
    everything = frame(spark, [("x", "a", 1), ("y", "a", 60), ("x", "a", 2), ("z", "a", 30), ("x", "a", 61), ("u", "a", 62)])
    for batch_id, ids in enumerate([[0], [1], [2, 3], [4, 5]]):
        part = everything.filter(everything.call_id.isin(ids))
        for _ in range(2):  # each batch is replayed once
            write(part, batch_id)
    got = decisions(spark.read.parquet(f"{tmp_path}/decisions"))
    assert got == [A, A, ledger.LATE, A, A, N]

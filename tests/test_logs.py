import random
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators import logs as L
from tidemark.operators import quotas as Q
from tidemark.operators.buckets import slice_function, token_bucket


def brute_bucket(times, requests, window):
    full, tokens, last, flags = requests * window, requests * window, None, []
    for t in times:
        if last is not None:
            tokens = min(full, tokens + (t - last) * requests)
        last = t
        if tokens >= window:
            tokens -= window
            flags.append((True, tokens))
        else:
            flags.append((False, tokens))
    return flags


def calls(spark, log):
    return spark.createDataFrame(log, "key string, call_id long, ts_us long")


@pytest.mark.parametrize("slice_rows", [1_000_000, 7, 1])
@pytest.mark.parametrize("requests, window", [(3, 600), (1, 50), (5, 37)])
def test_token_bucket_equals_one_by_one(spark, slice_rows, requests, window):
    rng = random.Random(requests * window)
    log, number = [], 0
    for key, n, pace in (("hot", 400, 9), ("calm", 60, 700), ("mixed", 200, 200), ("one", 1, 1)):
        t = 1_000
        for _ in range(n):
            t += rng.choice([0, 1, rng.randint(0, pace), rng.randint(0, 4 * pace)])
            log.append((key, number, t))
            number += 1
    want = {}
    for key in {k for k, _, _ in log}:
        mine = [(t, c) for k, c, t in log if k == key]
        for (t, c), flag in zip(mine, brute_bucket([t for t, _ in mine], requests, window)):
            want[c] = flag
    got = token_bucket(calls(spark, log), requests, window, slice_rows=slice_rows, tick_us=40)
    assert {r.call_id: (r.allowed, r.tokens) for r in got.collect()} == want


def test_token_bucket_boundaries(spark):
    minute = 60_000_000
    times = [0] * 4 + [minute // 3 - 1, minute // 3]
    log = [("k", i, t) for i, t in enumerate(times)]
    got = sorted((r.call_id, r.allowed) for r in token_bucket(calls(spark, log), 3).collect())
    # three at once, the fourth refused, one microsecond early refused, exactly one token allowed
    assert [a for _, a in got] == [True, True, True, False, False, True]


def test_slice_function_covers_every_start():
    rng = random.Random(5)
    for _ in range(50):
        requests, window = rng.randint(1, 4), rng.randint(1, 12)
        times, t = [], 0
        for _ in range(rng.randint(1, 12)):
            t += rng.randint(0, 9)
            times.append(t)
        pieces = slice_function(times, requests, window)
        full = requests * window
        for start in range(full + 1):
            tokens, last = start, times[0]
            for x in times:
                tokens = min(full, tokens + (x - last) * requests)
                last = x
                if tokens >= window:
                    tokens -= window
            s, offset, fixed = [p for p in pieces if p[0] <= start][-1]
            assert (offset if fixed else start + offset) == tokens


LOG = "key long, call_id long, ts timestamp, ts_us long, day date, thread_id string, tenant_id string"


def log_rows(spark, rows):
    out = []
    for i, (thread, tenant, ts) in enumerate(rows):
        micros = int((ts - datetime(1970, 1, 1)).total_seconds() * 1e6)
        out.append((i, i, ts, micros, ts.date(), thread, tenant))
    return spark.createDataFrame(out, LOG)


def random_log(seed, days, per_day=60):
    rng, rows = random.Random(seed), []
    for d in range(days):
        at = datetime(2024, 1, 1) + timedelta(days=d)
        for _ in range(per_day):
            at += timedelta(seconds=rng.randint(1, 600))
            tenant = rng.choice("ab")
            rows.append((f"{tenant}{rng.randint(0, 6)}", tenant, at))
    return rows


def decided(frame) -> list[str]:
    return [r.decision for r in sorted(frame.collect(), key=lambda r: r.call_id)]


A, T, N, D = "ADMITTED", "THREAD_CAP", "TENANT_DAY_CAP", "DAY_CAP"


@pytest.mark.parametrize(
    ("calls", "caps", "expect"),
    [
        ("a1 a1 a1 a2", (2, 9, 9), [A, A, T, A]),
        ("a1 a2 a3 b1 a1 b1", (9, 2, 9), [A, A, N, A, N, A]),
        ("a1 b1 a2 b2 c1", (9, 9, 3), [A, A, A, D, D]),
        # a3 is refused by its tenant, so it has used nothing when its thread is asked again
        ("a1 a2 a3 a3 b1 b1 b1", (2, 2, 9), [A, A, N, N, A, A, T]),
        # the thread is full before the day is, the day before the tenant
        ("a1 a1 b1 b2 a2", (1, 9, 2), [A, T, A, D, D]),
    ],
)
def test_quota_admission_by_hand(spark, calls, caps, expect):
    """Calls of one day as tenant and number of a thread; caps of threads, tenants and the day."""
    at = datetime(2024, 1, 1)
    rows = [(c, c[0], at + timedelta(hours=i)) for i, c in enumerate(calls.split())]
    thread, tenant, day = caps
    assert decided(L.quota_admission(log_rows(spark, rows), thread, tenant, global_day_cap=day)) == expect


@pytest.mark.parametrize("caps", [(4, 15, 15), (2, 9, 100)])
def test_both_forms_of_quotas_agree_within_a_day(spark, caps):
    log = log_rows(spark, random_log(1, 1))
    got = decided(L.quota_admission(log, *caps[:2], global_day_cap=caps[2]))
    assert got == decided(Q.admit(log, Q.Caps(*caps))) and len(set(got)) > 1


def test_both_forms_of_quotas_agree_over_days(spark):
    log = log_rows(spark, random_log(7, 3))
    assert decided(L.admit_by_day(log, 9, 20)) == decided(Q.admit(log, Q.Caps(9, 20, 20)))


def test_refused_calls_change_nothing(spark):
    rows = random_log(3, 1)
    got = decided(L.quota_admission(log_rows(spark, rows), 4, 15))
    kept = [row for row, decision in zip(rows, got, strict=True) if decision == A]
    assert set(decided(L.quota_admission(log_rows(spark, kept), 4, 15))) == {A}
    assert len(kept) < len(rows)


def test_thread_of_two_tenants_is_refused(spark):
    at = datetime(2024, 1, 1)
    with pytest.raises(L.ThreadSpansTenants):
        L.check_threads(log_rows(spark, [("t", "a", at), ("t", "b", at)]))


def test_usage(spark):
    rows = [("x", "a", datetime(2024, 1, 1, h)) for h in range(3)]
    got = {(r.scope, r.scope_key): (r.n_calls, r.is_over) for r in L.quota_usage(log_rows(spark, rows), 3, 2).collect()}
    assert got == {("thread", "x"): (3, False), ("tenant_day", "a/2024-01-01"): (3, True), ("day", "2024-01-01"): (3, True)}


def test_thread_state(spark):
    runs = spark.createDataFrame(
        [("a", 1, "E", None), ("a", 2, None, "fine"), ("b", 1, None, "x"), ("b", 2, "E2", None), ("c", 1, None, None)],
        "thread_id string, seq int, error_code string, response string",
    )
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "thread_id string")
    got = {r.thread_id: (r.state, r.response) for r in L.thread_state(asked, runs).collect()}
    assert got == {"a": ("OK", "fine"), "b": ("E2", None), "c": ("THREAD_INCOMPLETE", None), "d": ("THREAD_NOT_FOUND", None)}


def test_refresh_due_at_the_edges(spark):
    now = datetime(2024, 6, 1)
    manifest = spark.createDataFrame(
        [("i", "import", 2020, now - timedelta(hours=6), False), ("i", "import", 2021, now - timedelta(hours=6, seconds=1), False), ("i", "import", 2022, now - timedelta(days=180), True), ("i", "import", 2023, now - timedelta(days=181), True), ("i", "import", 2023, now - timedelta(days=1), True)],
        "item_code string, flow string, year int, fetched_at timestamp, is_finalized boolean",
    )
    expected = spark.createDataFrame([("i", "import", y) for y in range(2019, 2024)], "item_code string, flow string, year int")
    due = {r.year: r.reason for r in L.refresh_due(expected, manifest, "2024-06-01 00:00:00").collect()}
    assert due == {2019: "missing", 2021: "stale"}


def test_result_reuse(spark):
    at = datetime(2024, 6, 2)
    requests = spark.createDataFrame(
        [(1, "c", 2019, 2023, "f", at), (2, "c", 2019, 2022, "f", at), (3, "d", 2019, 2023, "f", at), (4, "e", 2019, 2023, "f", at)],
        "id int, hs_code string, year_start int, year_end int, fingerprint string, requested_at timestamp",
    )
    results = spark.createDataFrame(
        [("c", 2019, 2023, "f", "v1", at - timedelta(hours=24), "hit"), ("d", 2019, 2023, "f", "v1", at - timedelta(hours=25), "old"), ("e", 2019, 2023, "f", "v0", at, "version")],
        "hs_code string, year_start int, year_end int, fingerprint string, version string, written_at timestamp, result string",
    )
    got = {r.id: r.result for r in L.result_reuse(requests, results, "v1").collect()}
    assert got == {1: "hit", 2: None, 3: None, 4: None}


def test_result_reuse_sees_what_was_stored_before(spark):
    """A newer result that a request cannot know of yet does not hide an older one that is fresh."""
    at = datetime(2024, 6, 2, 1)
    key = ("c", 2019, 2023, "f")
    requests = spark.createDataFrame(
        [(1, *key, at), (2, *key, at + timedelta(hours=3)), (3, *key, at + timedelta(hours=30)), (4, *key, at - timedelta(hours=9))],
        "id int, hs_code string, year_start int, year_end int, fingerprint string, requested_at timestamp",
    )
    results = spark.createDataFrame(
        [(*key, "v1", at - timedelta(hours=8), "old"), (*key, "v1", at + timedelta(hours=2), "new"), (*key, "v1", at + timedelta(hours=2), "even newer")],
        "hs_code string, year_start int, year_end int, fingerprint string, version string, written_at timestamp, result string",
    )
    got = {r.id: r.result for r in L.result_reuse(requests, results, "v1").collect()}
    assert got == {1: "old", 2: "new", 3: None, 4: None}


def test_retention(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 3, 1),)], "ts timestamp")
    assert L.retain(rows, "ts", "2024-04-30 00:00:00").count() == 1
    assert date(2024, 3, 1) == L.retain(rows, "ts", "2024-04-30 00:00:00").first().ts.date()

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import logs as L
from tidemark.operators.buckets import token_bucket
from tidemark.streaming import ledger, state, tables

LOG = "key string, call_id long, ts timestamp, ts_us long, day date, thread_id string, tenant_id string"


def log(spark, n=480, seed=4):
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1, 20), []
    for i in range(n):
        at += timedelta(seconds=rng.randint(1, 120))
        user = rng.randint(0, 5)
        micros = int((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        rows.append((f"u{user}", i, at, micros, at.date(), f"{user}/{at.date()}", f"t{user % 2}"))
    return spark.createDataFrame(rows, LOG)


def stream(spark, frame, folder, files=4):
    """The rows as a file stream whose files arrive in order of time."""
    rows = frame.orderBy(*[c for c in ("call_id", "seq") if c in frame.columns]).collect()
    step = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], frame.schema)
        part.coalesce(1).write.parquet(f"{folder}/in/{i}")
    return (
        spark.readStream.schema(frame.schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(f"{folder}/in")
    )


def run(frame, name, folder, mode="append"):
    started = (
        frame.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination(180)
    return frame.sparkSession.table(name)


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    frame = log(spark)
    batch = token_bucket(frame, 3, 900_000_000)
    streamed = run(state.token_bucket_stream(stream(spark, frame, str(tmp_path)), 3, 900_000_000), "bucket", str(tmp_path))
    columns = ["key", "call_id", "allowed", "tokens"]
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert {r.allowed for r in streamed.collect()} == {True, False}


def test_hot_bucket_in_slices_equals_batch(spark, tmp_path):
    """A key with most of the calls is cut into slices in each micro-batch; tokens carry over."""
    frame = log(spark, 600).withColumn("key", F.when(F.col("key") < "u4", "hot").otherwise(F.col("key")))
    batch = token_bucket(frame, 3, 900_000_000)
    write = ledger.bucket_writer(str(tmp_path / "out"), 3, 900_000_000, slice_rows=20, compact_every=2)
    started = (
        stream(spark, frame, str(tmp_path), files=5)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination(300)
    streamed = spark.read.parquet(str(tmp_path / "out" / "flags"))
    columns = ["key", "call_id", "allowed", "tokens"]
    assert sorted(map(tuple, streamed.select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
    assert {r.allowed for r in streamed.collect()} == {True, False}


def test_late_calls_add_no_tokens(spark):
    """One token in 100 us; the bucket of one was emptied at 1000."""
    held = spark.createDataFrame([("k", 0, 1000), ("other", 100, 1000)], "key string, tokens long, last_us long")
    late = spark.createDataFrame([("k", 1, 900), ("k", 2, 1099), ("k", 3, 1100), ("new", 4, 5)], "key string, call_id long, ts_us long")
    got = {r.call_id: (r.allowed, r.tokens) for r in token_bucket(late, 1, 100, held=held).collect()}
    assert got == {1: (False, 0), 2: (False, 99), 3: (True, 0), 4: (True, 0)}


def test_quota_stream_equals_batch(spark, tmp_path):
    frame = log(spark)
    batch = L.quota_admission(frame, 8, 20, global_day_cap=10**6)
    streamed = run(state.quota_stream(stream(spark, frame, str(tmp_path)), 8, 20), "quota", str(tmp_path))
    assert sorted((r.call_id, r.decision) for r in streamed.collect()) == sorted((r.call_id, r.decision) for r in batch.collect())
    assert {r.decision for r in streamed.collect()} == {"ADMITTED", "THREAD_CAP", "TENANT_DAY_CAP"}


def test_usage_stream_emits_closed_days(spark, tmp_path):
    frame = log(spark)
    closed = run(tables.usage_stream(stream(spark, frame, str(tmp_path))), "usage", str(tmp_path))
    batch = frame.groupBy("day", "tenant_id").agg(F.count("*").alias("n"))
    want = {(r.day, r.tenant_id): r.n for r in batch.collect()}
    got = {(r.day, r.tenant_id): r.n_calls for r in closed.collect()}
    assert got and got == {k: want[k] for k in got} and len(got) < len(want)


def test_latest_runs_stream(spark, tmp_path):
    rows = [("a", 1, "E", None), ("b", 2, None, "x"), ("a", 3, None, "y"), ("b", 4, "E", None)]
    runs = spark.createDataFrame(rows, "thread_id string, seq int, error_code string, response string")
    updates = run(tables.latest_runs_stream(stream(spark, runs, str(tmp_path))), "runs", str(tmp_path), "update")
    final = L.latest_runs(updates.select(*runs.columns))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, L.latest_runs(runs).collect()))


def test_batch_writers_replace_a_replayed_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    frame = spark.createDataFrame([("k", at, "old"), ("k", at + timedelta(hours=1), "new")], "key string, written_at timestamp, result string")
    write = tables.result_writer(str(tmp_path / "results"), ["key"])
    write(frame, 0)
    write(frame, 0)
    assert [r.result for r in spark.read.parquet(str(tmp_path / "results")).collect()] == ["new"]
    tables.manifest_writer(str(tmp_path / "manifest"))(frame, 3)
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 2
    tables.retention_writer(str(tmp_path / "kept"), "written_at", "2024-03-31 00:30:00")(frame, 0)
    assert [r.result for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == ["new"]

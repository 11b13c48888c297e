"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the smallest hash among its inner s-mers stands first or last.
Whether a k-mer is chosen depends on the k-mer alone, so equal passages have equal anchors wherever they
stand, whatever surrounds them.  ``anchors`` returns all of them with their positions, for matching
passages between texts; ``fingerprints`` keeps of a text's anchors the SKETCH smallest hashes (all, if
fewer), a bottom-k sketch whose overlap estimates the share of common anchors.

A text without any closed syncmer (always, if shorter than K bytes) has one anchor, itself; the empty text
has none.  Two empty texts are alike (1), an empty and another one are not (0).  Null texts are empty.
Repeated rows and repeated ids are each fingerprinted; a null id sorts last.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, per_text, texts
from .pieces import running_hash, span_hash

K = 20
S = 6
SKETCH = 128
LEAST = -(1 << 63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def syncmers(raw: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and 64-bit hashes of a text's anchors."""
    n = len(raw)
    running = running_hash(np.frombuffer(raw, np.uint8))
    at = np.zeros(0, np.int64)
    if n >= k:
        starts = np.arange(n - s + 1)
        inner = span_hash(running, starts, starts + s)
        least = sliding_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    if len(at):
        return at, span_hash(running, at, at + k)
    at = np.zeros(min(n, 1), np.int64)
    return at, span_hash(running, at, at + n)


def sketch(raw: bytes, size: int = SKETCH) -> np.ndarray:
    """The smallest distinct 32-bit anchor hashes, ascending."""
    found = np.sort(syncmers(raw)[1] >> np.uint64(32)).astype(np.uint32)
    if len(found) > 1:
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return found[:size]


def written(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Estimated share of common anchors of two sketches, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    twice = np.zeros(len(both), bool)
    twice[:-1] = ~new[1:]
    twice = twice[new][:size]
    return float(np.count_nonzero(twice) / len(twice))


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, and for each anchor of the text its byte position and 64-bit hash."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        found = [syncmers(text.encode()) for text in batch]
        return {
            "doc_id": doc_ids,
            "positions": [at.astype(np.int32) for at, _ in found],
            "hashes": [h.view(np.int64) for _, h in found],
        }

    return per_text(texts(docs), "doc_id long, positions array<int>, hashes array<long>", rows)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of every whole text."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        return {
            "doc_id": doc_ids,
            "fingerprint": [written(sketch(text.encode())) for text in batch],
        }

    return per_text(texts(docs), "doc_id long, fingerprint string", rows)


def with_next(docs: DataFrame) -> DataFrame:
    """The rows of (doc_id, text) in runs of descending doc_id, each run followed by the next one's first.

    Columns run, guest, doc_id, text, sorted within partitions.  Runs are cut at quantiles of the id, so
    that none needs more than its own rows and one guest; the last run's guest is the very first row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(4 * parts, 4000)
    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(LEAST)))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = keyed.agg(F.percentile_approx("key", shares, F.lit(10_000))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    run = F.size(F.filter(bounds, lambda c: c > F.col("key")))
    keyed = keyed.withColumn("run", run).withColumn("guest", F.lit(False))
    firsts = sorted(keyed.groupBy("run").agg(F.max("key")).collect())  # one row for each run
    before = [(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))]
    heads = spark.createDataFrame(before, "key long, run int")
    # Broadcast: one row for each run, so 4,000 at most.
    guests = keyed.drop("run").join(F.broadcast(heads), "key").withColumn("guest", F.lit(True))
    columns = ["run", "guest", "doc_id", "text"]
    return (
        keyed.select(*columns)
        .unionByName(guests.select(*columns))
        .repartition(parts, "run")
        .sortWithinPartitions("run", "guest", F.col("doc_id").desc_nulls_last(), "text")
    )


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the following text's beginning."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edit_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(SCHEMA)
        last = None
        for batch in stream:
            out = []
            for run, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (run, doc_id, text, sketch(text.encode()))
                if last and last[0] == run:
                    out.append(report(last, row))
                last = None if guest else row
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)],
                schema=schema,
            )

    return with_next(texts(docs)).mapInArrow(batches, SCHEMA)


def report(own: tuple, following: tuple) -> tuple:
    _, doc_id, text, found = own
    changed = edited(text, following[2]).encode()
    other = sketch(changed)
    return (
        doc_id,
        len(text),
        hashlib.sha256(changed).hexdigest(),
        written(found),
        written(other),
        likeness(found, other),
        likeness(found, following[3]),
    )

"""Removal of repeated 50-byte strings by sorted suffixes.

A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id.  Strings
are judged on the input, and never cross documents.

Sorting the suffix at every byte would move many times the corpus.  Every string of SPAN bytes has one
anchor, the leftmost of its inner strings of WORD bytes with the least hash; it depends on the string
alone, so equal strings have equal anchors at equal places.  Only suffixes at anchors are sorted:

1. Anchors are dealt into buckets by hash, and those found in one document only are dropped.
2. The others are sent with the bytes of all strings they are the anchor of, range-partitioned by the
   leading bytes at the anchor with sampled splitters.  Equal strings never lie in two buckets, so there
   is nothing to compare across boundaries.  A hot anchor's strings are dealt by further bytes before
   or after it, which they share if they are equal.
3. Each bucket sorts its strings by eight bytes at a time, refining only what is still tied, and marks
   those that a smaller document has too.
4. Marked ranges are brought to their documents and cut out.

Whole copies of a text are found by digest first and take no part.  Only anchors, strings around repeated
anchors and ranges move, and each text once, for steps 2 and 4 together.

Null and empty texts have no bytes.  A null id counts as smaller than any other.  Rows with one id do not
repeat each other.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import arrow_schema, grouped, per_text, texts
from .fingerprints import sliding_min
from .pieces import mix, running_hash, span_hash

SPAN = 50
WORD = 24
#: Bytes of text whose anchors are found at once.
CHUNK = 1 << 22
#: An anchor in so many documents is hot.
HOT = 2000
#: Strings that reach at least so far left of a hot anchor are dealt by that many bytes before it; the
#: others reach at least RIGHT bytes beyond it.
LEFT = 8
RIGHT = SPAN - WORD - LEFT + 1
#: Buckets of anchors and of strings for each shuffle partition.
ANCHOR_BUCKETS, STRING_BUCKETS = 1, 6
SAMPLE_DOCS = 4000
_PLACE = np.uint64((1 << 24) - 1)
_HOT_BIT = np.uint64(1 << 62)
_LOW = np.uint64(0xFFFFFFFF)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors, and the first and last start of the strings they stand for.

    An anchor is listed once for each run of strings.
    """
    found = [_anchors(raw[i : i + CHUNK + SPAN - 1], i) for i in range(0, max(1, len(raw) - SPAN + 1), CHUNK)]
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _anchors(raw: bytes, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) - SPAN + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    starts = np.arange(len(raw) - WORD + 1)
    hashes = span_hash(running_hash(np.frombuffer(raw, np.uint8)), starts, starts + WORD)
    order = (hashes & ~_PLACE) | starts.astype(np.uint64)
    place = (sliding_min(order, SPAN - WORD + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    at = place[first]
    return at + shift, hashes[at], first + shift, last + shift


def codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, low bits of the hash in the lower half."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & _LOW)


def by_row(owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each owner; owners ascend."""
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
            yield owner[a].item(), values[a:b]


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def repeated_anchors(rows: DataFrame, buckets: int) -> DataFrame:
    """same, codes: of each text (by its hash) the codes of its anchors that another text has too."""
    sent = "bucket int, rows array<long>, counts array<int>, low binary"

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(sent)
        for batch in stream:
            owners, found = [], []
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.unique(codes(anchors(text.encode())[1], buckets))
                found.append(own)
                owners.append(np.full(len(own), row, np.int64))
            if not found:
                continue
            code, owner = np.concatenate(found), np.concatenate(owners)
            bucket = (code >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out = []
            for b, at in by_row(bucket[order], order):
                each = [(row, len(v)) for row, v in by_row(owner[at], at)]
                low = (code[at] & _LOW).astype("<u4").tobytes()
                out.append((b, [r for r, _ in each], [n for _, n in each], low))
            yield batch_of(schema, out)

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("same long, codes binary")
        for bucket, (_, owners, counts, lows) in grouped(stream):
            low = np.frombuffer(b"".join(lows), "<u4")
            owner = np.repeat(np.concatenate(owners), np.concatenate(counts))
            order = np.lexsort((owner, low))
            low, owner = low[order], owner[order]
            new = np.concatenate([[True], low[1:] != low[:-1]])
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(low)]]) - 1
            size = last - first + 1
            several = owner[first] != owner[last]
            code = np.uint64(bucket << 32) | low.astype(np.uint64)
            code |= np.where(size[group] >= HOT, _HOT_BIT, np.uint64(0))
            keep = np.flatnonzero(several[group])
            keep = keep[np.argsort(owner[keep], kind="stable")]
            out = [(row, v.tobytes()) for row, v in by_row(owner[keep], code[keep])]
            for i in range(0, len(out), 5000):
                yield batch_of(schema, out[i : i + 5000])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.xxhash64("text"), "text").mapInArrow(deal, sent)
    return (
        dealt.repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(judge, "same long, codes binary")
    )


def leading(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one big-endian number; zeros after the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[at + i]
    return out


def leading_everywhere(raw: np.ndarray) -> np.ndarray:
    """``leading`` of every place."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    out = np.zeros(len(raw), np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= padded[i : i + len(raw)]
    return out


def splitters(rows: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes that cut a sample's anchors into equal buckets; they decide balance only."""
    share = F.lit(SAMPLE_DOCS / max(1, rows.count()))

    def rows_of(row_ids: list, batch: list[str]) -> dict[str, list]:
        found = []
        for text in batch:
            raw = text.encode()
            found.append(leading(np.frombuffer(raw, np.uint8), anchors(raw)[0]) >> np.uint64(1))
        return {"lead": np.concatenate(found).astype(np.int64) if found else []}

    drawn = rows.where(F.pmod("row", F.lit(1 << 30)) < share * (1 << 30)).select("row", "text")
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = per_text(drawn, "lead long", rows_of).agg(F.percentile_approx("lead", shares, F.lit(10_000)))
    return np.unique(np.array(cuts.first()[0] or [], np.int64)).astype(np.uint64)


def strings_of(
    raw: bytes, wanted: np.ndarray, parts: int, cuts: np.ndarray
) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, first start, bytes) for runs of strings at wanted anchors."""
    at, hashes, first, last = anchors(raw)
    buckets = STRING_BUCKETS * parts
    code = codes(hashes, ANCHOR_BUCKETS * parts)
    hot = np.isin(code | _HOT_BIT, wanted)
    keep = hot | np.isin(code, wanted)
    at, first, last, hot = at[keep], first[keep], last[keep], hot[keep]
    array = np.frombuffer(raw, np.uint8)
    plain = np.searchsorted(cuts, leading(array, at) >> np.uint64(1), "right")
    for i in np.flatnonzero(~hot).tolist():
        yield int(plain[i]), int(first[i]), raw[first[i] : last[i] + SPAN]
    for i in np.flatnonzero(hot).tolist():
        a, lo, hi = int(at[i]), int(first[i]), int(last[i])
        far = min(hi, a - LEFT)
        if lo <= far:
            yield _spread(b"<" + raw[a - LEFT : a + WORD], buckets), lo, raw[lo : far + SPAN]
        near = max(lo, a - LEFT + 1)
        if near <= hi:
            yield _spread(b">" + raw[a : a + WORD + RIGHT], buckets), near, raw[near : hi + SPAN]


def _spread(key: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(key, digest_size=8).digest()) % buckets


def first_of_equal(words: Iterator[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """For each string the smallest document that has an equal one.

    Strings come as one array for each eight bytes.  Only strings tied so far are sorted by the next.
    """
    group = np.zeros(len(doc), np.int64)
    tied = np.arange(len(doc))
    for word in words:
        key = word[tied]
        order = np.lexsort((key, group[tied]))
        tied = tied[order]
        same = (group[tied][1:] == group[tied][:-1]) & (key[order][1:] == key[order][:-1])
        new = np.concatenate([[True], ~same]) if len(tied) else np.zeros(0, bool)
        group[tied] = tied[new][np.cumsum(new) - 1]  # a group is named by one of its strings
        alone = new & np.concatenate([new[1:], [True]]) if len(tied) else new
        tied = tied[~alone]
    least = doc.copy()
    np.minimum.at(least, group[tied], doc[tied])
    out = doc.copy()
    out[tied] = least[group[tied]]
    return out


def marked_ranges(rows: DataFrame, wanted: DataFrame, parts: int, cuts: np.ndarray) -> DataFrame:
    """row, spans: byte ranges (start, end) to remove from each row that has any, as pairs in one array."""
    sent = "bucket int, rows array<long>, docs array<long>, starts array<int>, sizes array<int>, bytes binary"
    joined = rows.join(wanted, "row").select("row", doc_key().alias("doc"), "text", "codes")

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(sent)
        for batch in stream:
            by_bucket: dict[int, list[tuple]] = {}
            for row, doc, text, codes_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                asked = np.frombuffer(b"".join(codes_of), "<u8")
                for bucket, start, string in strings_of(text.encode(), asked, parts, cuts):
                    by_bucket.setdefault(bucket, []).append((row, doc, start, string))
            out = []
            for bucket, found in by_bucket.items():
                row, doc, start, string = zip(*found, strict=True)
                out.append((bucket, row, doc, start, list(map(len, string)), b"".join(string)))
            for i in range(0, len(out), 50):
                yield batch_of(schema, out[i : i + 50])

    def judge(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("row long, spans array<int>")
        for _, (_, owners, docs, starts, sizes, joined_bytes) in grouped(stream):
            raw = np.frombuffer(b"".join(joined_bytes), np.uint8)
            owner, doc, start, size = (np.concatenate(c).astype(np.int64) for c in (owners, docs, starts, sizes))
            n = size - SPAN + 1
            begin = np.cumsum(size) - size
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(begin, n) + inner
            lead = leading_everywhere(raw)
            tail = np.uint64(8 * (8 - SPAN % 8) % 64)
            words = (
                lead[place + i] >> (tail if i + 8 > SPAN else np.uint64(0)) for i in range(0, SPAN, 8)
            )
            doc_of = np.repeat(doc, n)
            hit = np.flatnonzero(first_of_equal(words, doc_of) < doc_of)
            row_of, at = np.repeat(owner, n)[hit], (np.repeat(start, n) + inner)[hit]
            order = np.lexsort((at, row_of))
            out = []
            for row, p in by_row(row_of[order], at[order]):
                new = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + 1]))
                ends = p[np.concatenate([new[1:], [len(p)]]) - 1] + SPAN
                out.append((row, np.stack([p[new], ends], 1).reshape(-1)))
            for i in range(0, len(out), 5000):
                yield batch_of(schema, out[i : i + 5000])

    found = (
        joined.mapInArrow(deal, sent)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(judge, "row long, spans array<int>")
    )
    return found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as maximal ones."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(map(tuple, spans.reshape(-1, 2).tolist())):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def doc_key() -> Column:
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans of every row: the byte ranges to remove, as pairs in one array (null: none)."""
    rows = texts(docs).withColumn("row", F.xxhash64(doc_key(), "text")).select("row", "doc_id", "text")
    long_rows = rows.where(F.octet_length("text") >= SPAN)
    keys = materialize(
        long_rows.select(
            "row",
            doc_key().alias("doc"),
            F.xxhash64("text").alias("same"),
            F.unhex(F.md5("text")).alias("digest"),
            F.octet_length("text").cast("int").alias("n"),
        )
    )
    firsts = keys.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    copies = (
        keys.join(firsts.where("first_doc < last_doc"), "digest")
        .where("doc > first_doc")
        .groupBy("row")
        .agg(F.array(F.lit(0), F.first("n")).alias("spans"))
    )
    owners = keys.groupBy("same").agg(F.min_by("row", F.struct("doc", "row")).alias("row"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(long_rows, STRING_BUCKETS * parts)
    wanted = (
        repeated_anchors(long_rows, ANCHOR_BUCKETS * parts)
        .groupBy("same")
        .agg(F.collect_list("codes").alias("codes"))
        .join(owners, "same")
        .select("row", "codes")
    )
    # Dealt once: the same exchange serves both joins.
    dealt = rows.repartition(parts, "row")
    found = marked_ranges(dealt, wanted, parts, cuts).union(copies)
    return dealt.join(found, "row", "left").select("doc_id", "text", "spans")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        for batch in stream:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                ranges = merged(np.array(spans or [], np.int64))
                kept = cut_out(raw, ranges)
                out.append((doc_id, len(raw), len(raw) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            yield batch_of(schema, out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeated_ranges(docs).mapInArrow(batches, schema)


def cut_out(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """What is left without the ranges."""
    at, out = 0, []
    for start, end in ranges:
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]]) if out else raw

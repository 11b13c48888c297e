"""Harmonic packing of token sequences.

Harmonic packing sorts items into classes by reciprocals of the capacity: class k takes lengths above
capacity / (k + 1) up to capacity / k, and each of its bins takes exactly k items, whatever the other
classes hold.  As documents may be cut freely, pieces are cut to lengths that fill their class to the
brim: whole capacities first, then one piece for each power of two in what remains.  A class-k bin of k
such pieces is full.  What a class has left at its end is dealt to bins of 1, 2, 4, ... pieces, whose
lengths are powers of two and need no padding either.

Within a class a piece's number decides its bin and its place.  Numbers are given in parallel: pieces are
dealt into groups by a hash, numbered within each, and shifted by the sizes of the groups before.

Null and empty texts are one token, the end id.  Repeated rows are packed once each.  A null id is packed
like any other.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .byte_bpe import codec
from .common import per_text, texts

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END = 1


def cuts(n: int, capacity: int = CAPACITY) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    full = n - n % capacity
    yield from ((start, capacity) for start in range(0, full, capacity))
    start, size = full, capacity // 2
    while size:
        if n & size:
            yield start, size
            start += size
        size //= 2


def pieces(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, with ``ids`` also its tokens."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    where = path or public_tokenizers.path(TOKENIZER)

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        out: dict[str, list] = {
            name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
        }
        for doc_id, encoded in zip(doc_ids, codec(where).encode_all(batch), strict=True):
            tokens = encoded + struct.pack("<I", end)
            n = len(tokens) // 4
            for start, length in cuts(n, capacity):
                piece = tokens[4 * start : 4 * (start + length)]
                out["doc_id"].append(doc_id)
                out["start"].append(start)
                out["length"].append(length)
                out["ids_crc32"].append(zlib.crc32(piece))
                out["doc_tokens"].append(n)
                if ids:
                    out["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32))
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return per_text(texts(docs), schema + (", ids array<int>" if ids else ""), rows)


def numbered(cut: DataFrame) -> DataFrame:
    """Add ``number``, counting the pieces of each length from 0, and ``total``, how many there are."""
    groups = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        dealt.groupBy("length", "deal")
        .agg(F.count("*").alias("n"))
        .withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy("length")))
        .drop("n")
    )
    within = Window.partitionBy("length", "deal").orderBy("doc_id", "start", "ids_crc32")
    return (
        dealt.withColumn("place", F.row_number().over(within) - 1)
        .join(sizes, ["length", "deal"])
        .withColumn("number", F.col("shift") + F.col("place"))
        .drop("deal", "place", "shift")
    )


def last_bins(rest: Column, place: Column, most: int) -> tuple[Column, Column]:
    """Bin and place in it for the ``rest`` pieces at a class's end, dealt to bins of 2**b pieces each."""
    which, at = F.lit(0).cast("long"), place
    for b in range(most):
        higher = F.shiftleft(F.shiftright(rest, b + 1), b + 1)
        own = (rest.bitwiseAND(F.lit(1 << b)) > 0) & (place >= higher) & (place < higher + (1 << b))
        which = F.when(own, F.lit(most - b).cast("long")).otherwise(which)
        at = F.when(own, place - higher).otherwise(at)
    return which, at


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = False
) -> DataFrame:
    """The pieces of all documents with sequence_id and offset in it."""
    cut = numbered(materialize(pieces(docs, path, capacity, end, ids)))
    levels = capacity.bit_length()
    holds = (F.lit(capacity) / F.col("length")).cast("long")
    rest = F.col("total") % holds
    full = F.col("total") - rest
    in_rest = F.col("number") >= full
    which, at = last_bins(rest, F.col("number") - full, levels)
    bin_number = F.when(in_rest, full / holds + which).otherwise(F.floor(F.col("number") / holds))
    place = F.when(in_rest, at).otherwise(F.col("number") % holds)
    level = F.round(F.log2(F.col("length"))).cast("long")
    return cut.select(
        *[c for c in cut.columns if c not in ("number", "total")],
        (bin_number.cast("long") * levels + level).alias("sequence_id"),
        (place * F.col("length")).cast("long").alias("offset"),
    )

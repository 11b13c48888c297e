"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, grouping.

A document's set holds its distinct word shingles.  SuperMinHash draws for each element a permutation of
the slots and one rank per step; step j can only give values from j to j + 1, so a document is done as
soon as all its slots lie below the next step.  Steps run over all elements of a block of documents at
once.  Slots are banded; documents that share a band are candidates.  Links are confirmed on full sets.

Equal sets are one node from the start.  In every band's bucket the members are first compared with one
pivot.  Where a bucket still spans several components, all members outside its largest one are compared
with all members, in cells of bounded size that return no more links than join components.  So every
candidate pair is settled, pairs are never emitted, and where near copies hang on one pivot a bucket costs
about one comparison a member.

``kept`` marks the smallest id of each component.  Documents without words have empty sets and are linked
with nothing, like null texts.  A null id is linked with nothing, has no component and is kept.  Rows with
one id are one document: they share its component.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import grouped, per_text, texts
from .components import components, labels, ordered, stars
from .pieces import blocks, byte_hash, first_of_each, mix

BANDS = 36
#: A pair at the threshold may share no band with at most this probability.
MISS = 1e-6
#: Most sets of either side of a cell, on average, and shingles that are compared at once.
CELL = 512
WORDS_AT_ONCE = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def rows_per_band(threshold: float, bands: int = BANDS) -> int:
    """The most rows for which a pair at the threshold is missed with probability MISS at most."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows


def shingle_sets(encoded: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes."""
    joined = b"\n".join([*encoded, b""]).translate(_LOWER)
    raw = np.frombuffer(joined, np.uint8)
    white = np.concatenate([[True], _WHITE[raw], [True]])
    starts = np.flatnonzero(white[:-1] & ~white[1:])
    ends = np.flatnonzero(~white[:-1] & white[1:])
    words = byte_hash(joined, starts, ends)
    text_ends = np.cumsum([len(t) + 1 for t in encoded], dtype=np.int64)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)]).tolist()
    whole = words[: max(0, len(words) - size + 1)]
    for t in range(1, size):
        whole = mix(whole * _ODD + words[t : t + len(whole)])
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= size:
            found = np.sort(whole[a : b - size + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            short = words[a : a + 1] + np.uint64(b - a)  # apart from shingles of full size
            for t in range(a + 1, b):
                short = mix(short * _ODD + words[t : t + 1])
            out.append(short)
        else:
            out.append(words[:0])
    return out


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A signature of m slots for each set: step in the upper, rank in the lower half of 64 bits."""
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    chosen: list[np.ndarray] = []  # for each step, the place swapped with
    placed: list[np.ndarray] = []  # and what was put there
    for j in range(m):
        if not len(element):
            break
        draw = mix(element + np.uint64((j + 1) * int(_ODD) % (1 << 64)))
        place = (j + (draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int16)
        rank = (draw >> np.uint64(32)) | np.uint64(j << 32)
        slot, own = place.copy(), np.full(len(element), j, np.int16)
        for before, put in zip(chosen, placed, strict=True):
            slot = np.where(before == place, put, slot)
            own = np.where(before == j, put, own)
        chosen.append(place)
        placed.append(own)
        np.minimum.at(h.reshape(-1), owner * m + slot, rank)
        open_sets = h.max(axis=1) >= np.uint64((j + 1) << 32)
        going = open_sets[owner]
        if not going.all():
            element, owner = element[going], owner[going]
            chosen = [c[going] for c in chosen]
            placed = [p[going] for p in placed]
    return h


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of ``rows`` slots."""
    grouped = signatures.reshape(len(signatures), -1, rows)
    keys = np.broadcast_to(np.arange(grouped.shape[1], dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * _ODD + grouped[:, :, r])
    return keys


def signed(docs: DataFrame, size: int, threshold: float, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands of every document."""
    rows_each = rows_per_band(threshold, bands)

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": doc_ids, "n_shingles": [], "set_key": [], "bands": []}
        encoded = [text.encode() for text in batch]
        for first, last in blocks(encoded, 1 << 20):
            sets = shingle_sets(encoded[first:last], size)
            keys = band_keys(super_min_hash(sets, rows_each * bands), rows_each).view(np.int64)
            out["n_shingles"] += map(len, sets)
            out["set_key"] += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            out["bands"] += [k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)]
        return out

    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"
    return per_text(texts(docs), schema, rows)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """node, shingles (ascending 64-bit hashes as bytes) of (doc_id, text)."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        out: list[bytes] = []
        encoded = [text.encode() for text in batch]
        for first, last in blocks(encoded, 1 << 20):
            out += [s.tobytes() for s in shingle_sets(encoded[first:last], size)]
        return {"node": doc_ids, "shingles": out}

    return per_text(texts(docs), "node long, shingles binary", rows)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those with 100 * intersection >= percent * union on full sets."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    return joined.mapInArrow(batches, "u long, v long")


def alike(percent: int) -> str:
    """SQL for: sizes n and m allow the similarity."""
    return f"100 * least(n, m) >= {percent} * greatest(n, m)"


def open_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that span several components, with their component."""
    placed = (
        members.join(found, F.col("node") == F.col("member"), "left")
        .select("band", "member", "n", F.coalesce("component", "member").alias("component"))
    )
    spans = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return placed.join(spans.where("lo < hi").select("band"), "band")


def links(
    docs: DataFrame, nodes: DataFrame, same: DataFrame, size: int, percent: int
) -> DataFrame:
    """Components of nodes: (node, component) of all that have a link to another node.

    ``same`` has links (u, v) that hold anyway.
    """
    rows = nodes.select(F.explode("bands").alias("band"), F.col("node").alias("member"), "n")
    buckets = rows.groupBy("band").agg(
        F.min(F.struct(F.col("member").alias("v"), F.col("n").alias("m"))).alias("pivot"),
        F.max("member").alias("hi"),
    )
    buckets = buckets.where("pivot.v < hi").select("band", "pivot.v", "pivot.m")
    members = materialize(rows.join(buckets, "band"))
    wanted = members.select(F.col("member").alias("doc_id")).distinct()
    sets = materialize(full_sets(docs.join(wanted, "doc_id", "left_semi"), size))

    pairs = members.where("member <> v").where(alike(percent)).select(F.col("member").alias("u"), "v")
    # For now links are only contracted a little: that some components still count as two costs
    # comparisons, no links.
    edges = materialize(stars(ordered(confirmed(pairs.distinct(), sets, percent).union(same))))
    edges = materialize(stars(edges))
    found = labels(edges)

    cells = open_cells(materialize(open_buckets(members, found)), sets)
    more = materialize(ordered(links_of_cells(cells, percent)))
    return components(edges.union(more))


def open_cells(rows: DataFrame, sets: DataFrame, cell: int = CELL) -> DataFrame:
    """cell, outside, component, shingles: what is still to be compared, in blocks of bounded size.

    In each open bucket all members outside its largest component meet all members.  Both are dealt into
    blocks by a hash; a cell is one block of either.
    """
    sizes = rows.groupBy("band", "component").agg(F.count("*").alias("size"))
    shape = (
        sizes.groupBy("band")
        .agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"))
        .select(
            "band",
            F.col("main.component").alias("main"),
            F.ceil((F.col("all") - F.col("main.size")) / cell).alias("outer"),
            F.ceil(F.col("all") / cell).alias("inner"),
        )
    )
    placed = rows.join(shape, "band")
    own = F.xxhash64("member")

    def dealt(some: DataFrame, outside: bool, blocks: str, others: str) -> DataFrame:
        block, other = F.pmod(own, F.col(blocks)), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        pair = some.select("band", "member", "component", block.alias("block"), other.alias("other"))
        first, second = ("block", "other") if outside else ("other", "block")
        return pair.select(
            F.xxhash64("band", F.col(first), F.col(second)).alias("cell"),
            F.lit(outside).alias("outside"),
            "member",
            "component",
        )

    each = dealt(placed.where("component <> main"), True, "outer", "inner").union(
        dealt(placed, False, "inner", "outer")
    )
    return each.join(sets, F.col("node") == F.col("member")).select(
        "cell", "outside", "component", "shingles"
    )


def links_of_cells(cells: DataFrame, percent: int) -> DataFrame:
    """u, v: components that some pair of a cell links, at most one link less than a cell's components."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (_, outside, component, shingles) in grouped(stream):
            links = cell_links(np.array(outside), np.array(component), shingles, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"]
            )

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(batches, "u long, v long")


def cell_links(
    outside: np.ndarray, component: np.ndarray, shingles: list[bytes], percent: int
) -> list[tuple[int, int]]:
    """Links between the components of sets outside and any others, without those that add nothing."""
    n = np.array([len(s) // 8 for s in shingles])
    flat = np.frombuffer(b"".join(shingles), np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    rows, columns = np.flatnonzero(outside), np.flatnonzero(~outside)
    common = np.zeros((len(rows), len(columns)), np.float32)
    _, word = first_of_each(flat)
    often = np.bincount(word) > 1  # others are common to no two sets
    number = np.cumsum(often) - 1
    owner, word = owner[often[word]], number[word[often[word]]]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    place = np.empty(len(n), np.int64)
    place[rows], place[columns] = np.arange(len(rows)), np.arange(len(columns))
    words = int(number[-1]) + 1 if len(number) else 0
    for first in range(0, words, WORDS_AT_ONCE):  # products of 0/1 matrices count common words
        a, b = np.searchsorted(word, (first, first + WORDS_AT_ONCE))
        width = min(WORDS_AT_ONCE, words - first)
        left = np.zeros((len(rows), width), np.float32)
        right = np.zeros((len(columns), width), np.float32)
        mine, at = owner[a:b], word[a:b] - first
        out = outside[mine]
        left[place[mine[out]], at[out]] = 1
        right[place[mine[~out]], at[~out]] = 1
        common += left @ right.T
    both = n[rows][:, None] + n[columns][None, :]
    hit = (100 + percent) * common.astype(np.int64) >= percent * both
    hit &= component[rows][:, None] != component[columns][None, :]
    r, c = np.nonzero(hit)
    pairs = np.unique(np.stack([component[rows][r], component[columns][c]], 1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    links = []
    for u, v in pairs.tolist():
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            links.append((u, v))
    return links


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable, itself included), kept."""
    docs = texts(docs)
    signatures = materialize(signed(docs, size, percent / 100, bands))
    nodes = (
        signatures.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    nodes = materialize(nodes)
    placed = signatures.where("n_shingles > 0 and doc_id is not null").join(
        nodes.select("set_key", "node"), "set_key"
    ).select("doc_id", "node")
    # Rows with one id but different texts are one document: their nodes are linked.
    several = placed.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("hi"))
    same = placed.join(several.where("v < hi"), "doc_id").select(F.col("node").alias("u"), "v")
    found = links(docs.where("doc_id is not null"), nodes, same, size, percent)
    by_node = found.select("node", F.col("component").alias("component_id"))
    return (
        signatures.select("doc_id", "n_shingles", "set_key")
        .join(nodes.select("set_key", "node"), "set_key", "left")
        .join(by_node, "node", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(
                F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0),
                F.coalesce("component_id", "node"),
            ).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

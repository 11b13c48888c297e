"""Runs: stretches of words that repeat with a period, found as maximal pairs of a text's suffixes.

A pair of places (i, j) is maximal if the words from i and from j on agree for exactly n words and the
words before them differ.  If the distance j - i is at most n, the words from i to j + n repeat with that
distance, and neither neighbour goes on with it: such pairs are exactly the runs, and nothing has to be
extended.  Of several distances of one stretch the least is its period.

Pairs come bottom-up from the LCP-interval tree of the sorted suffixes.  A node has the places of its
words in order, and for each place its class, the word to its left.  When a child joins a node, each
place of the smaller list is held against its neighbours of the larger one: occurrences at the distance of
a smallest period have no third one between them, so neighbours of different classes suffice, and a place
changes lists a logarithmic number of times.

Most words can be in no run.  A run of period q holds at least max(12 - q, q) - 5 places in a row whose
next six words come again within q.  Stretches without such places are left out before sorting; this
loses no run (``suspects``).  Words are compared as bytes; hashes only choose suspects.

A null text is an empty one and has no words.  Very short texts have no runs.  Long texts are handled
alone, with memory in proportion to their words.  Repeated rows give repeated results; ids may be null or
occur several times.  Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text, texts
from .pieces import blocks, byte_hash, mix

#: Least words of a run; words of a gram (a run's pair agrees for at least as many).
LEAST = 12
GRAM = 6

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True

Run = tuple[int, int, int]  # start, length, period


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last bytes of the words."""
    white = np.concatenate([[True], _WHITE[np.frombuffer(raw, np.uint8)], [True]])
    return np.flatnonzero(white[:-1] & ~white[1:]), np.flatnonzero(~white[:-1] & white[1:])


def cycled(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original place of each word where a document's end is made periodic; None where it is not.

    Every tenth document by the CRC of its decimal id; none without an id.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def again(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word the distance to where it and the next ones come again in its text; 0 if nowhere."""
    out = np.zeros(len(words), np.int64)
    n = len(words) - GRAM + 1
    if n <= 0:
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    gram = mix(text[:n].astype(np.uint64) + _ODD)
    for k in range(GRAM):
        gram = mix(gram * _ODD + words[k : k + n])
    order = np.argsort(gram, kind="stable")
    same = gram[order[1:]] == gram[order[:-1]]
    inside = text[:n] == text[GRAM - 1 :]
    same &= inside[order[1:]] & inside[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretches(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of the marked stretches."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def suspects(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of places, apart from each other, that hold every run and the words on both its sides.

    In a run of period q and length q + n, the first n - 5 places come again within q, and q <= n.  So a
    stretch of s places that come again holds runs of period s + 5 at most, and its places that come again
    only later than that are no part of them; without them it falls into shorter stretches, and so on.
    """
    distance = again(words, bounds)
    while True:
        first, last = stretches(distance > 0)
        reach = np.repeat(last - first + GRAM - 1, last - first)
        at = np.flatnonzero(distance)
        far = at[distance[at] > reach]
        if not len(far):
            break
        distance[far] = 0
    if not len(first):
        return first, last
    text = np.searchsorted(bounds, first, "right") - 1
    lo = np.maximum(first - 1, bounds[text])
    hi = np.minimum(first + 2 * (last - first + GRAM), bounds[text + 1])
    # Ranges of a text that touch become one.
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], (lo[1:] > reach[:-1]) | (text[1:] != text[:-1])])
    ends = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])
    return lo[new], reach[ends]


def ranks(ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... numbers, until all differ; and their order."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.arange(n)
    new = np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, step = [rank.copy()], 1
    active = at[_shared(rank[order])]  # places in the order that are not settled
    while len(active):
        some = order[active]
        own = rank[some]
        then = rank[np.minimum(some + step, n)]
        by = np.lexsort((then, own))
        some, own, then = some[by], own[by], then[by]
        group = np.concatenate([[True], own[1:] != own[:-1]])
        part = group | np.concatenate([[True], then[1:] != then[:-1]])
        place = np.arange(len(some))
        shift = np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(
            np.where(group, place, 0)
        )
        order[active] = some
        rank[some] = own + shift
        levels.append(rank.copy())
        step *= 2
        active = active[_shared(own + shift)]
    return levels, order


def _shared(ordered: np.ndarray) -> np.ndarray:
    """Whether a neighbour in the order has the same rank."""
    same = ordered[1:] == ordered[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same])


def common_lengths(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Numbers that each suffix shares with the one before it in the order; 0 for the first."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]
        step = np.where(same, 1 << k, 0)
        out[1:] += step
        a += step
        b += step
    return out


def maximal_pairs(
    places: list[int], common: list[int], left: list[int], report: Callable[[int, int, int], None]
) -> None:
    """Report (place, distance, common words) of pairs of neighbouring occurrences whose left words differ.

    ``places`` are suffixes in order, ``common`` what each shares with the one before; only nodes of at
    least GRAM words, and distances up to the common words, count.
    """

    def join(node: list[int], child: list[int], n: int) -> list[int]:
        if len(node) < len(child):
            node, child = child, node
        for p in child:
            at = bisect.bisect_left(node, p)
            if at:
                q = node[at - 1]
                if p - q <= n and left[q] != left[p]:
                    report(q, p - q, n)
            if at < len(node):
                q = node[at]
                if q - p <= n and left[q] != left[p]:
                    report(p, q - p, n)
        if len(child) < 8:
            for p in child:
                bisect.insort(node, p)
        else:
            node += child
            node.sort()  # two ascending lists are merged
        return node

    stack: list[tuple[int, list[int]]] = []
    current: list[int] = []
    for place, n in zip(places, common, strict=True):
        while stack and stack[-1][0] > n:
            size, node = stack.pop()
            current = join(node, current, size)
        if n >= GRAM:
            if stack and stack[-1][0] == n:
                stack[-1] = (n, join(stack[-1][1], current, n))
            else:
                stack.append((n, current))
        current = [place]
    while stack:
        size, node = stack.pop()
        current = join(node, current, size)


def block_runs(encoded: list[bytes], ids: list[int | None] | None = None) -> list[list[Run]]:
    """The runs of each text by start, then period; with ``ids`` of the texts as ``cycled`` has them."""
    joined = b"\n".join([*encoded, b""])
    starts, ends = word_spans(joined)
    text_ends = np.cumsum([len(t) + 1 for t in encoded], dtype=np.int64)
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    for k, doc_id in enumerate(ids or []):
        places = cycled(int(bounds[k + 1] - bounds[k]), doc_id)
        if places is not None:
            a, b = bounds[k], bounds[k + 1]
            starts[a:b], ends[a:b] = starts[a:b][places], ends[a:b][places]
    out: list[dict[tuple[int, int], int]] = [{} for _ in encoded]
    lo, hi = suspects(byte_hash(joined, starts, ends), bounds)
    if len(lo):
        numbers = _numbers(joined, starts, ends, lo, hi)
        levels, order = ranks(numbers)
        common = common_lengths(levels, order)
        del levels
        sharing = (common >= GRAM) | np.concatenate([common[1:] >= GRAM, [False]])
        places = order[sharing].tolist()
        left = np.concatenate([[-1], numbers[:-1]]).tolist()
        begin = np.cumsum(np.concatenate([[0], hi - lo + 1]))

        def report(place: int, period: int, n: int) -> None:
            if period + n < LEAST:
                return
            piece = int(np.searchsorted(begin, place, "right")) - 1
            at = int(lo[piece]) + place - int(begin[piece])
            text = int(np.searchsorted(bounds, at, "right")) - 1
            found, run = out[text], (at - int(bounds[text]), period + n)
            found[run] = min(period, found.get(run, period))

        maximal_pairs(places, common[sharing].tolist(), left, report)
    return [sorted((s, n, p) for (s, n), p in found.items()) for found in out]


def _numbers(
    joined: bytes, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray
) -> np.ndarray:
    """A number for each word of the ranges, equal words of one range having one; each range is followed
    by a number of its own, so that nothing agrees beyond it or between ranges."""
    out: list[int] = []
    used = 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        seen: dict[bytes, int] = {}
        spans = zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)
        out += [seen.setdefault(joined[s:e], used + len(seen)) for s, e in spans]
        used += len(seen)
        out.append(used)
        used += 1
    return np.array(out, np.int64)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each word stays if only the first period of every run does."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def _batch(doc_ids: list, batch: list[str], cycle: bool):  # noqa: ANN202
    """(text as words, its runs) of every text."""
    encoded = [text.encode() for text in batch]
    for first, last in blocks(encoded):
        ids = doc_ids[first:last] if cycle else None
        for k, runs in enumerate(block_runs(encoded[first:last], ids), first):
            words = encoded[k].split()
            places = cycled(len(words), doc_ids[k]) if cycle else None
            yield words if places is None else [words[i] for i in places.tolist()], runs


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the starts, lengths and periods (in words) of all runs of every text."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        found = [runs for _, runs in _batch(doc_ids, batch, cycle=False)]
        columns = [[[run[k] for run in runs] for runs in found] for k in range(3)]
        return dict(zip(("doc_id", "starts", "lengths", "periods"), [doc_ids, *columns], strict=True))

    schema = "doc_id long, starts array<long>, lengths array<long>, periods array<long>"
    return per_text(texts(docs), schema, rows)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id and the text of which each run keeps its first period; words are joined by one space."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        found = _batch(doc_ids, batch, cycle=False)
        return {"doc_id": doc_ids, "text": [_collapsed(*each).decode() for each in found]}

    return per_text(texts(docs), "doc_id long, text string", rows)


def _collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    if not runs:
        return b" ".join(words)
    return b" ".join(itertools.compress(words, kept_words(len(words), runs).tolist()))


def run_report(docs: DataFrame) -> DataFrame:
    """Per document, of its words with a periodic end in every tenth one (``cycled``): the number of runs,
    the longest run (ties: least start, then period) and digests of all runs and of the collapsed text."""

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
        out: dict[str, list] = {name: [] for name in names}
        for words, runs in _batch(doc_ids, batch, cycle=True):
            start = length = period = milli = None
            if runs:
                start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                milli = 1000 * length // period
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            row = (
                len(runs),
                start,
                length,
                period,
                milli,
                hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(_collapsed(words, runs)).hexdigest(),
            )
            for name, value in zip(names, row, strict=True):
                out[name].append(value)
        return {"doc_id": doc_ids} | out

    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return per_text(texts(docs), schema, rows)

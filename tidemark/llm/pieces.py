"""Distinct byte pieces of a batch of texts, found with array operations.

Tokenisers cut texts at places that no token crosses, so equal pieces always give equal tokens.  A batch
holds each piece many times: pieces are grouped by a 64-bit hash of their bytes, every piece is compared
with the first of its group byte by byte, and only one of each is handed to Python.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 4 << 20
#: Spans of more bytes are hashed and compared one by one.
LONG_SPAN = 256

_ODD = np.uint64(BASE)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = (n >> 20) + 1 << 20
        for k, base in enumerate((BASE, INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def running_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE**position, with a leading zero."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, the same wherever the bytes stand."""
    _, down = powers(len(running))
    return mix((running[ends] - running[starts]) * down[starts])


def eights(raw: bytes) -> np.ndarray:
    """For every position of ``raw`` the eight bytes from there on as one number; zeros follow the end."""
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def column(view: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start, of which ``left`` bytes count."""
    return view[starts] & _MASKS[np.minimum(left, 8)]


def byte_hash(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, eight bytes at a time; for spans of one length up to eight bytes it is one to
    one.  Very long spans, of which there are few, go by a digest."""
    view = eights(raw)
    length = ends - starts
    h = mix(length.astype(np.uint64) + _ODD)
    at = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    done = 0
    while len(at):
        h[at] = mix(h[at] * _ODD + column(view, starts[at] + done, length[at] - done))
        done += 8
        at = at[length[at] > done]
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def unlike(raw: bytes, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the spans whose bytes differ from those of the span at the place in ``others``."""
    length = ends - starts
    differ = length != length[others]
    view = eights(raw)
    at = np.flatnonzero((others != np.arange(len(others))) & ~differ & (length > 0) & (length <= LONG_SPAN))
    done = 0
    while len(at):
        left = length[at] - done
        same = column(view, starts[at] + done, left) == column(view, starts[others[at]] + done, left)
        differ[at[~same]] = True
        done += 8
        at = at[same & (left > 8)]
    for i in np.flatnonzero((length > LONG_SPAN) & ~differ).tolist():
        j = others[i]
        differ[i] = raw[starts[i] : ends[i]] != raw[starts[j] : ends[j]]
    return np.flatnonzero(differ)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Pieces(NamedTuple):
    distinct: list[bytes]
    #: for each piece in text order, the place of its like in ``distinct``
    which: np.ndarray
    #: for each text, where its pieces begin in ``which``; one more at the end
    bounds: np.ndarray


def blocks(encoded: list[bytes], size: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    out, start, total = [], 0, 0
    for i, text in enumerate(encoded):
        if total and total + len(text) > size:
            out.append((start, i))
            start, total = i, 0
        total += len(text)
    return [*out, (start, len(encoded))] if encoded else out


def white_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is Unicode white space."""
    one, two, three = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    narrow = (one == 32) | ((one >= 9) & (one <= 13))
    latin = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (three == 0xE2) & (two == 0x80) & (
        (one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)
    )
    rest = (
        ((three == 0xE2) & (two == 0x81) & (one == 0x9F))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
        | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
    )
    return narrow | latin | general | rest


def mark_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a space or the sentence-piece mark ends before each position."""
    one, two, three = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (one == 32) | ((three == 0xE2) & (two == 0x96) & (one == 0x81))


def first_of_each(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and for each place the number of its value."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def distinct_pieces(encoded: list[bytes], uncut=white_before) -> Pieces:  # noqa: ANN001
    """Cut texts before each space, except where ``uncut`` says that the space belongs to a run."""
    joined = b"".join(encoded)
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in encoded], dtype=np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    spaces = np.flatnonzero(raw == 32)
    spaces = spaces[~uncut(raw, spaces)]
    begun = begins[begins < ends]
    starts = np.sort(np.concatenate([begun, spaces[~np.isin(spaces, begun)]]), kind="stable")
    bounds = np.searchsorted(starts, np.concatenate([begins, [len(raw)]]))
    stops = np.append(starts[1:], len(raw))
    first, which = first_of_each(byte_hash(joined, starts, stops))
    apart = unlike(joined, starts, stops, first[which])
    which[apart] = len(first) + np.arange(len(apart))  # of one hash, but other bytes: a piece of its own
    first = np.concatenate([first, apart])
    s, e = starts[first].tolist(), stops[first].tolist()
    return Pieces([joined[a:b] for a, b in zip(s, e, strict=True)], which, bounds)


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items of the given entries in turn, and how many each has.

    ``flat`` holds the items of all entries, ``sizes`` how many of them each entry has.
    """
    offsets = np.cumsum(sizes) - sizes
    n = sizes[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[which] - (ends - n), n)], n


def parts(text: bytes, size: int = BLOCK_BYTES, uncut=white_before) -> list[bytes]:  # noqa: ANN001
    """A text cut into parts of about ``size`` bytes, at spaces where pieces are cut anyway."""
    out, start = [], 0
    raw = np.frombuffer(text, np.uint8)
    while len(text) - start > size:
        first, cut = start + size, -1
        while cut < 0 and first < len(text):
            spaces = first + np.flatnonzero(raw[first : first + size] == 32)
            spaces = spaces[~uncut(raw, spaces)]
            cut = int(spaces[0]) if len(spaces) else -1
            first += size
        if cut < 0:
            break
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]

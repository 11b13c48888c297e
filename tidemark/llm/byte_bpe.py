"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Byte-level BPE works on characters that stand for bytes: each byte has one printable character, so any
UTF-8 text becomes a string without white space or control characters.  The BPE model is built from a
rank file alone.  Encoding maps each pre-token's bytes to characters and lets the library merge them;
decoding looks every id up in the reversed byte table and joins bytes, so a character whose bytes lie in
several tokens comes back whole.  Each token's span in characters is found the same way: a token that
begins inside a character starts at that character.

Pre-tokens are merged independently, so texts are cut at spaces that follow a non-space (where no
pre-token can cross) and a block's new pre-tokens are merged by one call of the library.  What is known is
kept once per pre-token, up to WORDS_KEPT of them; a text longer than a block is encoded in parts.

Null and empty texts give no ids.  Repeated rows give repeated results.  Any other column is ignored.
"""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import per_text, texts
from .pieces import BLOCK_BYTES, blocks, distinct_pieces, gather, parts

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens known at a time: some 150 bytes each.
WORDS_KEPT = 200_000
#: From here on, Unicode versions differ in what is a letter; the library's own splitter decides there.
SETTLED = "Ԁ"


def byte_characters() -> dict[int, str]:
    """The character for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def split_by_rank(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts of which a token is made last, by merges of lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        pairs = [ranks.get(a + b, len(ranks)) for a, b in itertools.pairwise(parts)]
        i = pairs.index(min(pairs))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


#: Kinds of pieces: a space and Latin letters are one pre-token, with a full stop or comma two.
OTHER, WORD, WORD_AND_STOP = range(3)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def letters_of(raw: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to an ASCII letter or to one from U+00C0 to U+017F.

    In UTF-8 the latter are the bytes C3 to C5 and one more; C3 97 and C3 B7 are signs.
    """
    out = _LETTER[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    after = raw[np.minimum(lead + 1, len(raw) - 1)]
    lead = lead[(raw[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))]
    out[lead] = True
    out[lead + 1] = True
    return out


def kinds(pieces: list[bytes]) -> np.ndarray:
    """The kind of each piece."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letters = np.concatenate([[0], np.cumsum(letters_of(raw))])
    after_space = (sizes > 1) & (raw[starts] == 32)
    whole = after_space & (letters[ends] - letters[starts + 1] == sizes - 1)
    last = raw[ends - 1]
    stop = after_space & (sizes > 2) & ((last == 46) | (last == 44))
    stop &= letters[ends - 1] - letters[np.minimum(starts + 1, ends - 1)] == sizes - 2
    return np.where(whole, WORD, np.where(stop, WORD_AND_STOP, OTHER))


class ByteBPE:
    """Encoder and decoder for one byte-level vocabulary.

    ``special`` maps strings that are never split or merged to their ids.
    """

    def __init__(
        self, tokenizer: Tokenizer, vocab: dict[str, int], pattern: str, special: dict[str, int]
    ) -> None:
        chars = byte_characters()
        byte_of = {c: b for b, c in chars.items()}
        self.tokenizer = tokenizer
        self.table = str.maketrans({chr(b): c for b, c in chars.items()})
        self.bytes_of = {
            i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in special
        } | {i: token.encode() for token, i in special.items()}
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.pattern = regex.compile(pattern)
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.forget()

    @classmethod
    def from_ranks(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
        """From ranks alone: a token's last merge is the one that lower ranks leave to it."""
        ranks = read_ranks(path)
        chars = byte_characters()

        def written(token: bytes) -> str:
            return "".join(chars[b] for b in token)

        by_rank = sorted(ranks, key=ranks.get)
        merges = [tuple(map(written, split_by_rank(t, ranks))) for t in by_rank if len(t) > 1]
        vocab = {written(t): r for t, r in ranks.items()}
        model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        return cls(Tokenizer(model), vocab, pattern, {})

    @classmethod
    def from_json(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
        """From a tokenizers file of a byte-level vocabulary without normaliser or prefix space."""
        with open(path) as lines:
            read = json.load(lines)
        steps = read["pre_tokenizer"] or {}
        if read["normalizer"] or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level tokenizer: {path}")
        loaded = Tokenizer.from_file(path)
        special = {t["content"]: t["id"] for t in read["added_tokens"]}
        return cls(Tokenizer(loaded.model), loaded.get_vocab(), pattern, special)

    def pre_tokens(self, text: str) -> list[str]:
        if max(text, default="") < SETTLED:
            return self.pattern.findall(text)
        return [part for part, _ in self.splitter.pre_tokenize_str(text)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in turn, and how many each has; one call of the library for all."""
        mapped = b"\0".join(words).decode("latin-1").translate(self.table)
        # No pre-token holds the character that stands for byte 0 unless a text has it.
        apart = mapped.split(self.table[0])
        if len(apart) != len(words):
            apart = [w.decode("latin-1").translate(self.table) for w in words]
        merged = self.tokenizer.encode(apart, is_pretokenized=True, add_special_tokens=False)
        owner = np.array(merged.word_ids, np.int64)
        return np.array(merged.ids, np.uint32), np.bincount(owner, minlength=len(words))

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces in turn, and how many each has; each pre-token is merged once."""
        if len(self.number) > WORDS_KEPT:
            self.forget()
        number, known = self.number, len(self.number)
        kind = kinds(pieces)
        word, stop, other = (np.flatnonzero(kind == k) for k in (WORD, WORD_AND_STOP, OTHER))
        split = [self.pre_tokens(pieces[i].decode()) for i in other.tolist()]
        counts = np.where(kind == WORD_AND_STOP, 2, 1)
        counts[other] = [len(words) for words in split]
        begin = np.cumsum(counts) - counts
        held = np.empty(int(counts.sum()), np.int64)
        # A pre-token that is asked for gets the next number if it has none.
        held[begin[word]] = [number[pieces[i]] for i in word.tolist()]
        held[begin[stop]] = [number[pieces[i][:-1]] for i in stop.tolist()]
        held[begin[stop] + 1] = [number[pieces[i][-1:]] for i in stop.tolist()]
        n = counts[other]
        at = np.repeat(begin[other] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        held[at] = [number[w.encode()] for words in split for w in words]
        if len(number) > known:
            ids, sizes = self.merge(list(itertools.islice(number, known, None)))
            self.flat, self.sizes = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, sizes])
        flat, n = gather(self.flat, self.sizes, held)
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(ends[np.concatenate([begin, [len(held)]])])

    def forget(self) -> None:
        """Start with no pre-token known."""
        self.number: dict[bytes, int] = collections.defaultdict(itertools.count().__next__)
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode_all(self, batch: list[str]) -> Iterator[bytes]:
        """The ids of each text, four bytes each."""
        if any(mark in text for mark in self.special for text in batch):
            yield from map(self.encode_around, batch)
            return
        encoded = [text.encode() for text in batch]
        for first, last in blocks(encoded):
            if last - first == 1 and len(encoded[first]) > BLOCK_BYTES:
                yield b"".join(itertools.chain.from_iterable(self._block([p]) for p in parts(encoded[first])))
            else:
                yield from self._block(encoded[first:last])

    def _block(self, encoded: list[bytes]) -> Iterator[bytes]:
        pieces = distinct_pieces(encoded)
        flat, sizes = self.ids_of(pieces.distinct)
        ids, n = gather(flat, sizes, pieces.which)
        bounds = np.concatenate([[0], np.cumsum(n)])[pieces.bounds]
        for start, end in itertools.pairwise(bounds.tolist()):
            yield ids[start:end].astype("<u4").tobytes()

    def encode_around(self, text: str) -> bytes:
        """Encode what lies between special strings, and those as their ids."""
        parts = self.special_pattern.split(text)
        parts[::2] = self.encode_all(parts[::2])
        parts[1::2] = [struct.pack("<I", self.special[mark]) for mark in parts[1::2]]
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        return b"".join(self.encode_all([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token; start and end in characters of the text.

        Tokens that share a character both cover it.
        """
        ids = np.frombuffer(self.encode(text), "<u4").tolist()
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts = ends - [len(self.bytes_of[i]) for i in ids] if ids else ends
        return [
            (i, int(char[s]), int(char[e - 1]) + 1)
            for i, s, e in zip(ids, starts.tolist(), ends.tolist(), strict=True)
        ]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    return ByteBPE.from_json(path) if path.endswith(".json") else ByteBPE.from_ranks(path)


def encoder_path(name: str = RANKS) -> str:
    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, spans: bool = False) -> DataFrame:
    """doc_id, ids (array), and with ``spans`` the first and one-past-last character of each token."""
    where = path or encoder_path()

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        bpe = codec(where)
        out: dict[str, list] = {"doc_id": doc_ids, "ids": [], "starts": [], "ends": []}
        for text in batch:
            got = bpe.spans(text)
            for name, k in (("ids", 0), ("starts", 1), ("ends", 2)):
                out[name].append([s[k] for s in got])
        return out

    def ids_only(doc_ids: list, batch: list[str]) -> dict[str, list]:
        encoded = codec(where).encode_all(batch)
        return {"doc_id": doc_ids, "ids": [np.frombuffer(b, "<u4").astype("i4") for b in encoded]}

    schema = "doc_id long, ids array<int>"
    if not spans:
        return per_text(texts(docs), schema, ids_only)
    return per_text(texts(docs), schema + ", starts array<int>, ends array<int>", rows)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of (doc_id, ids); a null list decodes to nothing."""
    where = path or encoder_path()

    def rows(doc_ids: list, batch: list) -> dict[str, list]:
        bpe = codec(where)
        return {
            "doc_id": doc_ids,
            "decoded": [bpe.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch],
        }

    return per_text(tokens.select("doc_id", "ids"), "doc_id long, decoded binary", rows)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every text in one pass and return the token count and both digests."""
    where = path or encoder_path()

    def rows(doc_ids: list, batch: list[str]) -> Iterator:
        bpe = codec(where)
        encoded = list(bpe.encode_all(batch))
        return {
            "doc_id": doc_ids,
            "n_tokens": [len(ids) // 4 for ids in encoded],
            "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids in encoded],
            "decoded_sha256": [hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in encoded],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(texts(docs), schema, rows)

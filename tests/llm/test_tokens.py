"""Tokenisers against their libraries, packing against the tokenizers library."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing, pieces, token_counts
from tidemark.llm.common import read
from tidemark.llm.queries import QUERIES

from .conftest import awkward_rows

ALPHABETS = ["ab \n\t'sre", "aAé 1!　\xa0  ", "՘ٟ中文 😀🏽 x", "the  a ", "<|endoftext|> ", "\r\n \x1c\x85 b"]


def random_texts(n: int) -> list[str]:
    draw = random.Random(4)
    return ["".join(draw.choice(draw.choice(ALPHABETS)) for _ in range(draw.randint(0, 40))) for _ in range(n)] + [
        "".join(draw.choices(alphabet, k=30)) for alphabet in ALPHABETS for _ in range(n // 10)
    ]


@pytest.fixture(scope="module")
def reference() -> tiktoken.Encoding:
    ranks = byte_bpe.read_ranks(byte_bpe.encoder_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_rank_library(reference):
    texts = random_texts(3000)
    bpe = byte_bpe.codec(byte_bpe.encoder_path())
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_long_texts_in_parts(reference, monkeypatch):
    """Texts longer than a block are cut where nothing crosses: any block size gives the same."""
    texts = [*random_texts(300), " ".join(random_texts(200)), "no blanks" * 40, "a  b " * 30]
    bpe = byte_bpe.codec(byte_bpe.encoder_path())
    count = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    whole, counts = list(bpe.encode_all(texts)), count.count(texts)
    for size in (7, 40):
        for module in (byte_bpe, token_counts):
            monkeypatch.setattr(module, "BLOCK_BYTES", size)
            monkeypatch.setattr(module, "parts", functools.partial(pieces.parts, size=size))
            monkeypatch.setattr(module, "blocks", functools.partial(pieces.blocks, size=size))
        assert list(bpe.encode_all(texts)) == whole
        assert count.count(texts) == counts
    for text in texts:
        assert b"".join(pieces.parts(text.encode(), 9)) == text.encode()


def test_spans_cover_split_characters():
    bpe = byte_bpe.codec(byte_bpe.encoder_path())
    text = "a 😀é"
    spans = bpe.spans(text)
    assert spans[0][1] == 0 and spans[-1][2] == len(text)
    assert all(a[2] >= b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(1 for _, s, e in spans if s <= 2 < e) > 1  # the emoji lies in several tokens
    assert bpe.spans("") == []


def test_special_strings_of_the_json_vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, bpe = Tokenizer.from_file(path), byte_bpe.codec(path)
    for text in [*random_texts(500), "x<|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext|>"]:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_counts_equal_the_piece_library():
    path = public_tokenizers.path(token_counts.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*random_texts(3000), " ", "  ", "a▁b", "▁", "▁▁ x", "<s> </s> <0x0A>"]
    assert token_counts.counter(path).count(texts) == [len(library.encode(t)) for t in texts]


def test_queries_on_awkward_rows(spark, awkward, reference):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    expect, counts = [], []
    for doc_id, text, *_ in awkward_rows():
        ids = np.array(reference.encode_ordinary(text or ""), "<u4").tobytes()
        raw = (text or "").encode()
        expect.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
        n = len(library.encode(text or ""))
        counts.append((doc_id, len(raw), n, n > 4096))
    key = repr
    assert sorted(map(tuple, QUERIES["op7_byte_bpe"](spark, awkward).collect()), key=key) == sorted(expect, key=key)
    assert sorted(map(tuple, QUERIES["op9_token_counts"](spark, awkward).collect()), key=key) == sorted(counts, key=key)


def test_encode_and_decode_tables(spark, awkward):
    docs = read(spark, awkward, "documents")
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    expect = [(i, (t or "").encode()) for i, t, *_ in awkward_rows()]
    assert sorted(((r[0], bytes(r[1])) for r in back), key=repr) == sorted(expect, key=repr)
    assert byte_bpe.encode(docs, spans=True).where("size(ids) <> size(starts)").count() == 0


def check_packing(rows, texts: dict, capacity: int = packing.CAPACITY) -> None:
    """Every id in one piece, sequences gapless, no padding but at powers of two."""
    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, copies in texts.items():
        tokens = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in copies]
        expect = sorted(
            (start, size, zlib.crc32(t[start : start + size].tobytes()), len(t))
            for t in tokens
            for start, size in packing.cuts(len(t), capacity)
        )
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc_id]) == expect
    for places in by_sequence.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity and at & (at - 1) == 0


def test_packing(spark, awkward):
    texts = defaultdict(list)
    for doc_id, text, *_ in awkward_rows():
        texts[doc_id].append(text)
    check_packing(QUERIES["op4_harmonic_packing"](spark, awkward).collect(), texts)


def test_packing_with_ids_and_another_capacity(spark, awkward):
    docs = read(spark, awkward, "documents").where("doc_id in (6, 12)")
    rows = packing.pack(docs, capacity=64, ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in rows)
    with pytest.raises(ValueError, match="power of two"):
        packing.pieces(docs, capacity=100)


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 5000])
def test_cuts_cover(n):
    at = 0
    for start, size in packing.cuts(n):
        assert start == at and size & (size - 1) == 0
        at += size
    assert at == n


def colliding_texts() -> list[str]:
    """Different texts to which any polynomial hash modulo 2**64 gives one value, as words and in words."""
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    return [one, other, f"{one} {other}", f"x {other} {one} {other}", f" {one}", f" {other}"]


def test_colliding_texts_keep_their_tokens(spark, reference, tmp_path):
    from .conftest import write

    rows = [(i, text, "en", "a") for i, text in enumerate(colliding_texts())]
    folder = write(tmp_path, rows, [])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digests = {r.doc_id: r for r in QUERIES["op7_byte_bpe"](spark, folder).collect()}
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op9_token_counts"](spark, folder).collect()}
    packed = {r.doc_id: r.doc_tokens for r in QUERIES["op4_harmonic_packing"](spark, folder).collect()}
    groups = {r.doc_id: r.component_id for r in QUERIES["op3_superminhash"](spark, folder).collect()}
    for doc_id, text, *_ in rows:
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert digests[doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert digests[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert counts[doc_id] == len(pieces.encode(text))
        assert packed[doc_id] == len(library.encode(text, add_special_tokens=False).ids) + 1
    assert groups == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 5: 1}

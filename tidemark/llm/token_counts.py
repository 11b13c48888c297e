"""Token counts with a whole-token shortcut.

The model writes a space as a mark and puts one in front of a text.  No piece of the vocabulary has the
mark after another character (checked when a model is loaded), so merges never cross the place before
a mark that follows another character, and a text's count is the sum over the runs between those places.
Which runs are one token is proved once per model: every piece that starts with the mark is encoded
alone, and those that come back as that single piece are counted from then on without the library.
The remaining runs are merged by the library, each distinct one once per batch; their counts are kept
in a cache of bounded size.

Null and empty texts have no tokens.  Repeated rows give repeated results.  Other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .common import per_text, texts
from .pieces import BLOCK_BYTES, blocks, distinct_pieces, mark_before, parts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
RUNS_KEPT = 400_000
LIMIT = 4096


class PieceCounter:
    """Counts the tokens of texts by one model."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("a piece holds the space mark after another character")
        self.single = {b" " + w.replace(MARK, " ").encode(): 1 for w in self._proved(pieces)}
        # The mark cannot be encoded alone, as the library puts one in front: take a difference.
        self.single[b" "] = len(self.library.encode("a ")) - len(self.library.encode("a"))
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _proved(self, pieces: list[str]) -> list[str]:
        """The runs, without their first mark, that the library gives as one token."""
        words = [p[1:] for p in pieces if p.startswith(MARK)]
        encoded = self.library.encode([w.replace(MARK, " ") for w in words], num_threads=1)
        return [w for w, ids in zip(words, encoded, strict=True) if len(ids) == 1]

    def ask(self, runs: list[bytes]) -> list[int]:
        """Counts of distinct runs; what is neither proved nor remembered is merged by the library."""
        known = [self.single.get(r) or self.young.get(r) or self.old.get(r) for r in runs]
        new = [r for r, n in zip(runs, known, strict=True) if n is None]
        words = [r[1:].decode().replace(MARK, " ") for r in new]
        counts = dict(zip(new, map(len, self.library.encode(words, num_threads=1)), strict=True))
        if len(self.young) > RUNS_KEPT:
            self.old, self.young = self.young, {}
        self.young.update(counts)
        return [counts[r] if n is None else n for r, n in zip(runs, known, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        encoded = [b" " + text.encode() if text else b"" for text in texts]
        for first, last in blocks(encoded):
            if last - first == 1 and len(encoded[first]) > BLOCK_BYTES:
                own = parts(encoded[first], uncut=mark_before)
                out.append(sum(n for part in own for n in self._block([part])))
            else:
                out += self._block(encoded[first:last])
        return out

    def _block(self, encoded: list[bytes]) -> list[int]:
        runs = distinct_pieces(encoded, mark_before)
        counts = np.array(self.ask(runs.distinct), np.int64)[runs.which]
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[runs.bounds]).tolist()


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every whole text."""
    where = path or public_tokenizers.path(MODEL)

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        counts = counter(where).count(batch)
        return {
            "doc_id": doc_ids,
            "n_bytes": [len(text.encode()) for text in batch],
            "n_tokens": counts,
            "over_limit": [n > limit for n in counts],
        }

    return per_text(
        texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows
    )

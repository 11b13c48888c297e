"""Language identification in two steps: the family first, then the languages within it.

A text is lower-cased and counted in hashed byte trigrams; square roots of the counts, at length one, are
its features.  Linear support vector machines, one for each pair, vote between the families, and then
between the languages of the winning family.  Everything is learned from labelled rows: a language of a
known family joins it, any other one is a family of its own.

The classifier is fitted on a sample of at most about SAMPLE_ROWS labelled rows, drawn by a hash of the id
and spread evenly over the languages; the bound is a parameter.  Prediction covers every whole text.

A null text and a text without any letter are ``und`` with score 0.  Ties between classes go to the name
that sorts first.  Without any labelled row everything is ``und``; with a single language it is always
predicted.  Null labels and null ids teach nothing and are predicted like any other row.  Repeated rows
give repeated results.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, texts

SAMPLE_ROWS = 2000
BITS = 13
UNKNOWN = "und"
HELD_OUT = 2

# Families of languages.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Digits and punctuation of ASCII become spaces.
_BLANK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Square roots of hashed trigram counts, at length one (all zero for the empty text)."""
    raw = np.frombuffer(b" " + text.lower().encode().translate(_BLANK) + b" ", np.uint8)
    x = raw.astype(np.uint32)
    grams = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    slots = (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    counts = np.sqrt(np.bincount(slots, minlength=1 << BITS)).astype(np.float32)
    counts[_EMPTY] = 0  # blanks only
    size = np.sqrt(counts @ counts)
    return counts / size if size else counts


_EMPTY = int((np.uint64(0x202020) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - BITS))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def support_vectors(x: np.ndarray, y: np.ndarray, steps: int = 100, cost: float = 20.0) -> np.ndarray:
    """Weights of a linear SVM (squared hinge), by accelerated gradient descent; the last column of x is 1."""
    w = np.zeros(x.shape[1], np.float32)
    y = y.astype(np.float32)
    ahead = w
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight = weight.astype(np.float32)
    rate = np.float32(1.0 / (1.0 + 4.0 * cost))
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = ahead - np.float32(2 * cost) * (x.T @ (weight * slack * y))
        new = ahead - rate * gradient
        ahead = new + np.float32(step / (step + 3)) * (new - w)
        w = new
    return w


@dataclass
class Vote:
    """One-versus-one machines between named classes."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> Vote:
        names = sorted(set(labels))
        at = np.array([names.index(label) for label in labels])
        pairs = list(itertools.combinations(range(len(names)), 2))
        rows = []
        for a, b in pairs:
            own = (at == a) | (at == b)
            rows.append(support_vectors(x if own.all() else x[own], np.where(at[own] == a, 1.0, -1.0)))
        return cls(names, pairs, np.array(rows, np.float32).reshape(len(pairs), x.shape[1]))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes, then the largest sum of margins, and a score from 0.5 to 1."""
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes = np.zeros(len(self.names))
        sums = np.zeros(len(self.names))
        for (a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.names)), key=lambda i: (votes[i], sums[i], -i))
        own = [m if a == best else -m for (a, b), m in zip(self.pairs, margins.tolist(), strict=True) if best in (a, b)]
        nearest = min(own, default=10.0)
        return self.names[best], 1 / (1 + float(np.exp(-4 * max(-10.0, min(10.0, nearest)))))


@dataclass
class Model:
    families: Vote
    languages: dict[str, Vote]

    def predict(self, text: str) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families.predict(x)
        language, more = self.languages[family].predict(x)
        return language, sure * more


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], f"other {lang}")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id written as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def labelled(docs: DataFrame) -> DataFrame:
    """The rows to learn from: with label, text and id, not held out."""
    return docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT)
    ).select("doc_id", "lang", "text")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on a bounded sample; None if there is nothing to learn from."""
    rows = labelled(docs)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(1, sample_rows // len(counts))
    shares = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, each / n)])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(shares, F.col("lang")) * (1 << 30)

    def rows_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = [[], [], [], []]
            for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    out[0].append(doc_id)
                    out[1].append(lang)
                    x = features(text)
                    slots = np.flatnonzero(x)
                    out[2].append(slots.astype("<u2").tobytes())
                    out[3].append(x[slots].tobytes())
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)],
                names=["doc_id", "lang", "slots", "values"],
            )

    schema = "doc_id long, lang string, slots binary, values binary"
    sample = rows.where(drawn).mapInArrow(rows_of, schema).collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], r["slots"], r["values"]))
    x = np.zeros((len(sample), (1 << BITS) + 1), np.float32)
    x[:, -1] = 1  # for the bias
    for row, r in zip(x, sample, strict=True):
        row[np.frombuffer(r["slots"], "<u2")] = np.frombuffer(r["values"], np.float32)
    langs = [r["lang"] for r in sample]
    del sample
    groups = [family(lang) for lang in langs]
    inner = {}
    for name in set(groups):
        own = [i for i, g in enumerate(groups) if g == name]
        inner[name] = Vote.fit(x[own], [langs[i] for i in own])
    return Model(Vote.fit(x, groups), inner)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pairs of classes x 8,193 weights

    def rows(doc_ids: list, batch: list[str]) -> dict[str, list]:
        model = shared.value
        found = [model.predict(t) if model else (UNKNOWN, 0.0) for t in batch]
        return {
            "doc_id": doc_ids,
            "lang_pred": [lang for lang, _ in found],
            "score": [score for _, score in found],
        }

    done = per_text(texts(docs), "doc_id long, lang_pred string, score double", rows)
    held_out = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and predict all of them."""
    return predict(docs, fit(docs, sample_rows))


def keep_identified(docs: DataFrame, least_score: float = 0.0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of the rows whose text has an identified language of at least this score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_rows))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in stream:
            found = [model.predict(t or "") if model else (UNKNOWN, 0.0) for t in batch.column(at).to_pylist()]
            keep = [lang != UNKNOWN and score >= least_score for lang, score in found]
            yield batch.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(batches, docs.schema)

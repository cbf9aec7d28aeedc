"""Language of a text by error-correcting output codes.

Every language has a codeword. For each bit of the code, a binary classifier on
character n-grams tells the languages with 1 from those with 0 (difference of
smoothed log frequencies, every language weighing the same). A text's bits are
decoded to the codeword with the least loss; a bit's loss weighs by how often its
classifier was right for that language in training. A text whose two best
codewords are about as good is flagged.

The fit uses a bounded sample (``per_language`` documents of each language);
every text is scored whole.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if
nothing was learned; with one learned language that language has score 1; ties go
to the smaller language value; repeated rows get equal results."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.base import pieces
from docreg.llm.sample import labelled_sample

PER_LANGUAGE = 1_500
UNKNOWN = "und"
_ORDERS = (2, 3, 4)
_PLACES = 1 << 16
_PIECE_BYTES = 1_000_000
_letter = re.compile(r"[^\W\d_]")
#: Letters stay, ASCII in lower case; every other ASCII byte becomes a space.
_PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 per class: all splits of the classes in two for up to
    seven classes, else a fixed random code with 12 bits per doubling."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        bits = [b for b in itertools.product((1, -1), repeat=n) if b[0] == 1 and -1 in b]
        return np.array(bits, dtype=np.int8).T
    rng = np.random.default_rng(n)
    width = int(12 * np.ceil(np.log2(n)))
    while True:
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, width))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all():
            return code


def _places(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the hashed place of the n-gram that starts at each byte of
    the joined texts; and where each text starts. n-grams do not run from one text
    into the next: three spaces stand between."""
    raw = [f" {t}".lower().encode("utf-8", "surrogatepass").translate(_PLAIN) + b"   " if t else b"    " for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw) + b"   ", dtype=np.uint8).astype(np.uint32)
    n = int(sizes.sum())
    gram, found = data[:n].copy(), []
    for order in range(2, max(_ORDERS) + 1):
        gram = (gram << np.uint32(8)) | data[order - 1 : n + order - 1]
        if order in _ORDERS:
            found.append(((gram * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64))
    return found, np.cumsum(sizes) - sizes


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights, trust

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Mean evidence for each bit, per text."""
        places, begin = _places(texts)
        total = sum(np.add.reduceat(self.weights[i][p], begin, axis=0) for i, p in enumerate(places))
        return total / np.diff(np.r_[begin, len(places[0])])[:, None]

    def losses(self, bits: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each codeword, per text."""
        hit = np.exp(-np.clip(bits, -3, 3))
        miss = np.exp(np.clip(bits, -3, 3))
        return hit @ (self.trust * (self.code > 0)).T + miss @ (self.trust * (self.code < 0)).T

    def decode(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the choice is ambiguous."""
        known = np.array([bool(t and _letter.search(t)) for t in texts], dtype=bool)
        if not self.languages:
            known[:] = False
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if len(self.languages) == 1:
            return [self.languages[0] if k else UNKNOWN for k in known], known.astype(float), ~known
        losses = self.losses(self.bits(texts))
        best = losses.argmin(axis=1)
        closeness = np.exp(-4 * (losses - losses.min(axis=1, keepdims=True)))
        score = np.where(known, 1 / closeness.sum(axis=1), 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, score < 0.6


def fit(sample: list[tuple[str, str]]) -> Model:
    languages = sorted({lang for _, lang in sample})
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((len(_ORDERS), _PLACES, 1), np.float32), np.ones(code.shape))
    texts = [[t for t, lang in sample if lang == x] for x in languages]
    rates = np.zeros((len(_ORDERS), len(languages), _PLACES))
    for c, own in enumerate(texts):
        for low in range(0, len(own), 256):
            for i, places in enumerate(_places(own[low : low + 256])[0]):
                rates[i, c] += np.bincount(places, minlength=_PLACES)
    rates = (rates + 0.5) / (rates + 0.5).sum(axis=2, keepdims=True)
    weights = np.zeros((len(_ORDERS), _PLACES, code.shape[1]))
    for b in range(code.shape[1]):
        weights[:, :, b] = np.log(rates[:, code[:, b] > 0].mean(axis=1)) - np.log(rates[:, code[:, b] < 0].mean(axis=1))
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape))
    bits = [np.concatenate([model.bits(own[low : low + 256]) for low in range(0, len(own), 256)]) for own in texts]
    model.weights = (model.weights / (np.abs(np.concatenate(bits)).mean(axis=0) + 1e-9)).astype(np.float32)
    right = np.array([((b * code[c]) > 0).mean(axis=0) for c, b in enumerate(bits)])
    model.trust = (right + 1e-3) / (right + 1e-3).sum(axis=1, keepdims=True)
    return model


def identify_language(docs: DataFrame, may_learn: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every document, learned from the
    texts with a language among the rows where ``may_learn`` (a condition on
    doc_id) holds."""
    may_learn = F.lit(True) if may_learn is None else may_learn
    model = fit(labelled_sample(docs, docs.select("doc_id", "lang"), "lang", may_learn, per_language)[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE_BYTES):
                lang, score, unsure = model.decode(part.column("text").to_pylist())
                yield pa.record_batch([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")

"""Document quality from good and bad lines, by a linear-chain conditional random
field over the lines of a text.

A line is described by its own make-up (kinds of characters, words, repeats) and
that of the lines before and after it. The labels are per document: a first fit,
on each line for itself, takes every line of a bad document as bad; the lines of bad
documents that it finds good then count as good, all but the worst, and the field
is fitted on whole texts. Forward-backward marginals, weighted by line length, make
the document's score.

The fit uses a bounded sample of labelled rows (``per_class`` of each label);
every text is scored whole.

Defined results: null and empty texts are one empty line; without labelled rows of
both kinds every score is the prior of what there is (0.5 without any); rows are
scored one by one, so repeated rows get equal scores."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm import crf
from docreg.llm.base import coded_words, pieces
from docreg.llm.sample import filtered, labelled_sample, logistic, probability, share_of_ones

PER_CLASS = 1_500
_PIECE_BYTES = 6_000_000
#: Lines, and about bytes, whose features are held at once.
WINDOW, _WINDOW_BYTES = 20_000, 4_000_000

#: Kinds of bytes: members of each kind; all other ASCII bytes are kind 0, bytes of other characters kind 1.
_KINDS = ["", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", ".,;:'\"-", "!?", "|", "#$%&*", "<>{}[]()/\\=_"]
_KIND_OF = np.zeros(256, dtype=np.uint8)
_KIND_OF[128:] = 1
for _kind, _members in enumerate(_KINDS):
    for _c in _members:
        _KIND_OF[ord(_c)] = _kind
_OWN = len(_KINDS) + 6


def _line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of features per line, and the lines' lengths in bytes."""
    raw = [line.encode("utf-8", "surrogatepass") + b"\n" for line in lines]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    kinds = _KIND_OF[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    begin, length = np.cumsum(sizes) - sizes, sizes - 1
    x = np.zeros((len(lines), _OWN))
    some = np.maximum(length, 1)
    for kind in range(len(_KINDS)):
        x[:, kind] = np.add.reduceat(kinds == kind, begin, dtype=np.int32) / some
    x[:, 0] -= 1 / some  # the line end
    n = len(_KINDS)
    counts, codes, _ = coded_words(lines)
    words = np.maximum(counts, 1)
    line_of = np.repeat(np.arange(len(lines)), counts)
    same = np.r_[False, (codes[1:] == codes[:-1]) & (line_of[1:] == line_of[:-1])] if len(codes) else np.zeros(0, bool)
    x[:, n] = np.bincount(line_of[same], minlength=len(lines)) / words
    x[:, n + 1] = np.log1p(length) / 5
    x[:, n + 2] = np.minimum(length / words, 40) / 10
    last = kinds[np.maximum(begin + length - 1, begin)]
    x[:, n + 3] = (last == 6) * (length > 0)
    x[:, n + 4] = kinds[begin] == 2
    x[:, n + 5] = length == 0
    return x, length


def _lines(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    lines: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = (text or "").split("\n")
        counts[i] = len(found)
        lines += found
    return lines, counts


class LineFeatures:
    """Features of each line beside those of its neighbours in the same text."""

    def __init__(self, texts: list[str | None], scale: tuple[np.ndarray, np.ndarray] | None = None):
        lines, self.counts = _lines(texts)
        own, self.length = _line_features(lines) if lines else (np.zeros((0, _OWN)), np.zeros(0, np.int64))
        self.scale = scale or (own.mean(axis=0), own.std(axis=0) + 1e-3)
        own = np.clip((own - self.scale[0]) / self.scale[1], -5, 5)
        text = np.repeat(np.arange(len(texts)), self.counts)
        before, after = np.zeros_like(own), np.zeros_like(own)
        joined = (text[1:] == text[:-1])[:, None]
        before[1:], after[:-1] = own[:-1] * joined, own[1:] * joined
        self.x = np.column_stack([own, before, after, np.ones(len(own))])
        self.size = self.x.shape[1]

    def alone(self) -> LineFeatures:
        """The same lines without their neighbours."""
        other = copy(self)
        other.x = np.column_stack([self.x[:, :_OWN], self.x[:, -1:]])
        other.size = other.x.shape[1]
        return other

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return self.x @ weights

    def pull(self, g: np.ndarray) -> np.ndarray:
        return self.x.T @ g


@dataclass
class Marked:
    """What scoring keeps of the lines of some texts: lines of each text, bytes of each
    line."""

    counts: np.ndarray
    length: np.ndarray


def _windows(lines: list[str]) -> Iterator[list[str]]:
    """The lines in runs of at most ``WINDOW`` lines and about ``_WINDOW_BYTES``."""
    held, size = 0, 0
    for i, line in enumerate(lines):
        size += len(line)
        if i - held + 1 >= WINDOW or size >= _WINDOW_BYTES:
            yield lines[held : i + 1]
            held, size = i + 1, 0
    if held < len(lines):
        yield lines[held:]


def _emission(lines: list[str], counts: np.ndarray, scale: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The field's evidence for each line, and the lines' lengths, as ``LineFeatures``
    has them. A line's features are only kept as what they add to its own evidence and
    to that of the lines beside it, so memory does not go with the number of features."""
    shares = weights[: 3 * _OWN].reshape(3, _OWN).T
    added, length = np.empty((len(lines), 3)), np.empty(len(lines), dtype=np.int32)
    at = 0
    for some in _windows(lines):
        own, size = _line_features(some)
        added[at : at + len(some)] = np.clip((own - scale[0]) / scale[1], -5, 5) @ shares
        length[at : at + len(some)] = size
        at += len(some)
    joined = np.ones(max(0, len(lines) - 1), dtype=bool)
    ends = np.cumsum(counts)[:-1]
    joined[ends[(ends > 0) & (ends < len(lines))] - 1] = False
    found = added[:, 0] + weights[-1]
    found[1:] += added[:-1, 1] * joined
    found[:-1] += added[1:, 2] * joined
    return found, length


class Model:
    """A fitted field (tag 1 is a bad line) and the weights of the score."""

    def __init__(self, chain: crf.Chain, scale, weights: np.ndarray):
        self.chain, self.scale, self.weights = chain, scale, weights

    def mark(self, texts: list[str | None]) -> tuple[Marked, np.ndarray]:
        """The lines, and each line's probability of being bad."""
        lines, counts = _lines(texts)
        emission, length = _emission(lines, counts, self.scale, self.chain.weights)
        return Marked(counts, length), crf.marginals(crf.Sequences(counts), emission, self.chain)[0]

    @staticmethod
    def evidence(lines: Marked, bad: np.ndarray) -> np.ndarray:
        """Per document: log odds of the length-weighted share of good lines, and
        the share itself."""
        if not len(lines.counts):
            return np.zeros((0, 2))
        begin = np.cumsum(lines.counts) - lines.counts
        weight = lines.length + 1.0
        good = np.add.reduceat(weight * (1 - bad), begin) / np.add.reduceat(weight, begin)
        near = np.clip(good, 1e-4, 1 - 1e-4)
        return np.column_stack([np.log(near / (1 - near)) / 3, good])

    def score(self, lines: Marked, bad: np.ndarray) -> np.ndarray:
        return probability(self.evidence(lines, bad), self.weights)


def fit(sample: list[tuple[str, int]], prior: float = 0.5) -> Model:
    """The field on four fifths of the sample, the score's weights on the rest."""
    texts, good = [t for t, _ in sample], np.array([int(y) for _, y in sample], dtype=np.int64)
    size = 3 * _OWN + 1
    if not len(texts) or good.min() == good.max():
        return Model(crf.Chain(np.zeros(size)), (np.zeros(_OWN), np.ones(_OWN)), logistic(np.zeros((len(texts), 2)), good, prior))
    rest = np.arange(len(texts)) % 5 == 4
    learn = np.flatnonzero(~rest)
    lines = LineFeatures([texts[i] for i in learn])
    from_bad = np.repeat(good[learn] == 0, lines.counts)
    alone = np.ones(len(from_bad), dtype=np.int64)
    own = lines.alone()
    first = crf.train(own, from_bad.astype(np.int64), alone)
    p = crf.marginals(crf.Sequences(alone), own.scores(first.weights), first)[0]
    worst = np.repeat(np.maximum.reduceat(p, np.cumsum(lines.counts) - lines.counts), lines.counts)
    chain = crf.train(lines, (from_bad & ((p >= 0.5) | (p == worst))).astype(np.int64), lines.counts)
    model = Model(chain, lines.scale, np.zeros(3))
    tested = np.flatnonzero(rest) if len(set(good[rest].tolist())) == 2 else np.arange(len(texts))
    model.weights = logistic(model.evidence(*model.mark([texts[i] for i in tested])), good[tested], prior)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, n_lines, bad_lines) of every document: ``bad_lines`` are the
    numbers, from 0, of lines more likely bad than good. Labels are learned from
    rows where ``may_learn`` (a condition on doc_id) holds."""
    sample, sizes = labelled_sample(docs, labels, "quality", F.lit(True) if may_learn is None else may_learn, per_class)
    model = fit(sample, share_of_ones(sizes))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", _PIECE_BYTES):
                lines, bad = model.mark(part.column("text").to_pylist())
                begin = np.cumsum(lines.counts) - lines.counts
                numbers = np.arange(len(bad)) - np.repeat(begin, lines.counts)
                kept = bad > 0.5
                ends = np.r_[0, np.cumsum(np.add.reduceat(kept.astype(np.int64), begin))]
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[kept], pa.int32()))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(model.score(lines, bad)), pa.array(lines.counts, pa.int64()), found],
                    names=["doc_id", "score", "n_lines", "bad_lines"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, n_lines long, bad_lines array<int>")


def keep_good(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS, bar: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``bar``, with all their columns."""
    sample, sizes = labelled_sample(docs, labels, "quality", F.lit(True) if may_learn is None else may_learn, per_class)
    return filtered(docs, fit(sample, share_of_ones(sizes)), lambda score: score >= bar)

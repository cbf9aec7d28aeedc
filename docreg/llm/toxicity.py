"""Toxic spans and documents by a linear-chain conditional random field.

The labels are per document, so tokens are labelled first: in toxic documents, a
token is toxic if its word or one of its beginnings is far more frequent there
than in other documents. Frequency counts distinct preceding words, so a text that
was copied often is no evidence. The field learns from these tokens; marginals by
forward-backward tag the tokens of every document, and their strongest marginal
and their number make the document's score.

The fit uses a bounded sample of labelled rows (``per_class`` of each label);
every text is scored whole.

Defined results: null and empty texts have no tokens and get the lowest score
that the fit knows; without labelled rows of both kinds every score is the prior
of what there is (0.5 without any); rows are scored one by one, so repeated rows
get equal scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm import crf
from docreg.llm.base import pieces
from docreg.llm.sample import filtered, labelled_sample, logistic, probability, share_of_ones

PER_CLASS = 1_500
_BITS = 18
_BEGINNINGS = (3, 4, 5)
_TRAIN_SPAN = 128
_PIECE_BYTES = 6_000_000
#: Marginals below this say nothing; a long text has many of them.
_FAINT = 0.02
_token = re.compile(r"\w+")


def _parts(word: str) -> list[str]:
    """Features of a token: the word, its beginnings, its last letters."""
    word = word.lower()
    return [f"w{word}", *[f"{n}{word[:n]}" if len(word) >= n else "" for n in _BEGINNINGS], f"e{word[-3:]}"]


class TokenFeatures:
    """Hashed features by distinct word, and the word of each position."""

    def __init__(self, words: list[str], at: np.ndarray):
        self.at, self.size = at, 1 << _BITS
        mask = self.size - 2
        # place 0 is the bias, which every word has; a missing beginning is the last place
        self.index = np.array(
            [[0, *[1 + xxhash.xxh3_64_intdigest(p) % mask if p else self.size - 1 for p in _parts(w)]] for w in words], dtype=np.int64
        ).reshape(len(words), 2 + len(_BEGINNINGS) + 1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return weights[self.index].sum(axis=1)[self.at]

    def pull(self, g: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.at, weights=g, minlength=len(self.index))
        return np.bincount(self.index.ravel(), weights=np.repeat(by_word, self.index.shape[1]), minlength=self.size)


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    found: list[str] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            words = _token.findall(text)
            lengths[i] = len(words)
            found += words
    coded = pa.array(found, pa.string()).dictionary_encode()
    return lengths, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def label_tokens(texts: list[str], toxic: np.ndarray, support: int = 6, ratio: float = 30.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Token tags from document labels: (tags, lengths, word of each position, words)."""
    lengths, at, words = _tokens(texts)
    doc = np.repeat(np.arange(len(texts)), lengths)
    before = np.where(np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool), -1, np.r_[0, at[:-1]] if len(at) else at)
    kinds = toxic[doc].astype(np.int64)
    # distinct (label, word, word before)
    seen = np.unique((kinds * len(words) + at) * (len(words) + 1) + before + 1) // (len(words) + 1) if len(at) else at
    times = np.bincount(seen, minlength=2 * len(words)).reshape(2, len(words))
    by_part: tuple[Counter, Counter] = (Counter(), Counter())
    parts = [_parts(w)[:-1] for w in words]
    for kind in (0, 1):
        for w in np.flatnonzero(times[kind]):
            for part in parts[w]:
                if part:
                    by_part[kind][part] += int(times[kind, w])
    rate = (times[1].sum() + 1) / (times[0].sum() + 1)
    marked = {p for p, n in by_part[1].items() if n >= support and (n + 0.5) / (by_part[0][p] + 0.5) > ratio * rate}
    is_marked = np.array([any(p in marked for p in ps) for ps in parts], dtype=bool)
    return (is_marked[at] & (kinds == 1)).astype(np.int64), lengths, at, words


def _cut(lengths: np.ndarray, span: int) -> np.ndarray:
    """Sequences cut into spans for training; positions stay in order."""
    return np.concatenate([np.r_[np.full(n // span, span), [n % span] if n % span else []] for n in lengths] or [np.zeros(0)]).astype(np.int64)


class Model:
    """A fitted field and the weights that turn marginals into a score."""

    def __init__(self, chain: crf.Chain, weights: np.ndarray):
        self.chain, self.weights = chain, weights

    def mark(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Length of each text in tokens, and every token's probability."""
        lengths, at, words = _tokens(texts)
        emission = TokenFeatures(words, at).scores(self.chain.weights) if len(at) else np.zeros(0)
        return lengths, crf.marginals(crf.Sequences(lengths), emission, self.chain)[0]

    @staticmethod
    def evidence(lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Per document: log odds of the strongest token, and the logs of the
        expected number of toxic tokens and of the number of likely ones."""
        out = np.tile([-12.0, np.log(_FAINT), 0.0], (len(lengths), 1))
        full = np.flatnonzero(lengths)
        if len(full):
            begin = (np.cumsum(lengths) - lengths)[full]
            top = np.clip(np.maximum.reduceat(p, begin), 1e-6, 1 - 1e-6)
            out[full, 0] = np.log(top / (1 - top))
            out[full, 1] = np.log(_FAINT + np.add.reduceat(np.where(p >= _FAINT, p, 0.0), begin))
            out[full, 2] = np.log1p(np.add.reduceat((p >= 0.5).astype(np.float64), begin))
        return out

    def score(self, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        return probability(self.evidence(lengths, p), self.weights)


def fit(sample: list[tuple[str, int]], prior: float = 0.5) -> Model:
    """The field on four fifths of the sample, the score's weights on the rest."""
    texts, toxic = [t for t, _ in sample], np.array([int(y) for _, y in sample], dtype=np.int64)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(crf.Chain(np.zeros(1 << _BITS)), logistic(np.zeros((len(texts), 3)), toxic, prior))
    rest = np.arange(len(texts)) % 5 == 4
    learn = np.flatnonzero(~rest)
    tags, lengths, at, words = label_tokens([texts[i] for i in learn], toxic[learn])
    chain = crf.train(TokenFeatures(words, at), tags, _cut(lengths, _TRAIN_SPAN), ridge=1e-7)
    model = Model(chain, np.zeros(4))
    tested = np.flatnonzero(rest) if len(set(toxic[rest].tolist())) == 2 else np.arange(len(texts))
    model.weights = logistic(model.evidence(*model.mark([texts[i] for i in tested])), toxic[tested], prior)
    return model


_SPANS = "array<struct<start:int,end:int,p:double>>"


def score_toxicity(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS, bar: float = 0.5) -> DataFrame:
    """(doc_id, score, n_toxic, spans) of every document: spans are the character
    offsets of runs of tokens whose marginal reaches ``bar``, with the strongest
    marginal of the run. Labels are learned from rows where ``may_learn`` (a
    condition on doc_id) holds."""
    sample, sizes = labelled_sample(docs, labels, "toxic", F.lit(True) if may_learn is None else may_learn, per_class)
    model = fit(sample, share_of_ones(sizes))

    def spans_of(text: str, p: np.ndarray) -> list[dict]:
        runs: list[dict] = []
        last = -2
        for i, found in enumerate(_token.finditer(text)):
            if p[i] >= bar:
                if last == i - 1:
                    runs[-1] |= {"end": found.end(), "p": max(runs[-1]["p"], float(p[i]))}
                else:
                    runs.append({"start": found.start(), "end": found.end(), "p": float(p[i])})
                last = i
        return runs

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            for part in pieces(batch, "text", _PIECE_BYTES):
                texts = part.column("text").to_pylist()
                lengths, p = model.mark(texts)
                begin = np.cumsum(lengths) - lengths
                hits = np.add.reduceat(np.r_[p >= bar, False].astype(np.int64), begin) * (lengths > 0)
                spans = [spans_of(t, p[b : b + n]) if h else [] for t, b, n, h in zip(texts, begin, lengths, hits)]
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(model.score(lengths, p)), pa.array(hits, pa.int64()), pa.array(spans, kind)],
                    names=["doc_id", "score", "n_toxic", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, n_toxic long, spans {_SPANS}")


def keep_civil(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = PER_CLASS, bar: float = 0.5) -> DataFrame:
    """The documents whose score stays below ``bar``, with all their columns."""
    sample, sizes = labelled_sample(docs, labels, "toxic", F.lit(True) if may_learn is None else may_learn, per_class)
    return filtered(docs, fit(sample, share_of_ones(sizes)), lambda score: score < bar)

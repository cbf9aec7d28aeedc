"""Language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimate of a word after the word before it
with the smoothed estimate of the word alone. How much either counts depends on how
often the context was seen: contexts are bucketed by the power of two of their
frequency, and each bucket has a mixture weight, learned by expectation
maximisation on held-out counts (texts kept out of the counts that are mixed). The
final estimates use the counts of all texts that may be learned from.

Counting and lookup are one exchange. Texts are dealt, packed, in chunks of bounded
size; a chunk counts its distinct words and word pairs and sends them, sorted by
hash and cut by hash range, to the range's task. That task sums each key over all
chunks, and answers each chunk with the sums of the keys that others hold too, by
their place in what the chunk sent: a key that only one chunk holds has that
chunk's own count. A chunk's counts and its answers are all that its texts need for
their scores. A frequent word is sent once per chunk, whatever its frequency, so
there is no hot key.

Words are told apart by a hash of 63 bits, pairs by one of 56. Defined results: null and empty
texts are the end token alone; a null id counts as the empty text for its fold;
without training texts every weight is 0 and scores are those of the base;
repeated rows are scored and counted each; texts of equal id and content lie in one
chunk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docreg.common import reliable
from docreg.llm.base import coded_words, paired, word_hashes

#: Bytes of text in a chunk, and bytes of text whose keys one range holds.
CHUNK_BYTES = 6_000_000
RANGE_BYTES = 6_000_000
#: Bytes of text of one chunk that are packed together on their way.
_PACK_BYTES = 400_000
_U64 = np.uint64
_END, _START = _U64(0x0DDC0FFEE0DDF00C), _U64(0x51A27051A27051A2)
_LEARN, _DELETED, _HELD = 0, 1, 2
#: Steps per power of two in which ratios are summed up for the fit.
_FINE = 16


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses sorted and small ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


class Chunk:
    """Distinct keys of a chunk of texts with their counts: words first (the end
    token and the start context last among them), then pairs."""

    def __init__(self, texts: list[str | None]):
        counts, codes, words = coded_words(texts)
        n_words, n = len(words), len(texts)
        end, start = n_words, n_words + 1
        self.sizes = counts + 1
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.word = np.full(int(self.sizes.sum()), end, dtype=np.int64)
        self.word[np.arange(len(codes)) + np.repeat(np.arange(n), counts)] = codes
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.begin] = start
        pairs, self.pair, times = np.unique(before * (n_words + 2) + self.word, return_inverse=True, return_counts=True)
        self.first, self.second = pairs // (n_words + 2), pairs % (n_words + 2)
        hashes = np.r_[word_hashes(words), _END, _START]
        keys = np.r_[hashes & ~_U64(1), paired(hashes[self.first], hashes[self.second]) & ~_U64(0xFF) | _U64(1)]
        counted = np.r_[np.bincount(self.word, minlength=n_words + 1), n, times]
        self.n_words = n_words + 2
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.counts = keys[self.order], counted[self.order]

    def placed(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values by sorted key as values by word and values by pair."""
        out = np.empty_like(values)
        out[self.order] = values
        return out[: self.n_words], out[self.n_words :]

    def cuts(self, n_ranges: int) -> np.ndarray:
        """Where each hash range begins among the sorted keys."""
        place = ((self.keys >> _U64(32)) * _U64(n_ranges) >> _U64(32)).astype(np.int64)
        return np.searchsorted(place, np.arange(n_ranges + 1))

    def totals(self, kind: int, answers: pa.Table, n_ranges: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Counts over all texts that may be learned from, and over the deleted
        ones: the chunk's own where no answer came."""
        learned = self.counts * (kind != _HELD)
        deleted = self.counts * (kind == _DELETED)
        cuts = self.cuts(n_ranges)
        for r, shared, seen, apart in zip(*(answers[c].to_pylist() for c in ("range", "shared", "seen", "apart"))):
            n = cuts[r + 1] - cuts[r]
            at = cuts[r] + np.flatnonzero(np.unpackbits(np.frombuffer(shared, np.uint8), count=n))
            learned[at] = _numbers(seen, np.int64)
            if apart is not None:
                deleted[at] = _numbers(apart, np.int64)
        return self.placed(learned), self.placed(deleted)


def _packed(kind: pa.DataType):
    """Texts of a task packed by chunk: ids, sizes (-1 for null) and the texts."""

    def row(chunk: int, ids: list, texts: list) -> dict:
        raw = [t.encode("utf-8", "surrogatepass") if t is not None else None for t in texts]
        sizes = np.array([-1 if t is None else len(t) for t in raw], dtype=np.int32)
        return {"chunk": chunk[0], "kind": chunk[1], "ids": ids, "sizes": sizes.tobytes(), "texts": zstandard.compress(b"".join(t for t in raw if t), 3)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(kind)), ("sizes", pa.binary()), ("texts", pa.binary())])
        held: dict[tuple, tuple[list, list, list]] = {}
        total = 0
        for batch in batches:
            for doc_id, text, k, c in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "kind", "chunk"))):
                ids, texts, size = held.setdefault((c, k), ([], [], [0]))
                ids.append(doc_id)
                texts.append(text)
                size[0] += len(text or "") + 16
                total += len(text or "") + 16
                if size[0] > _PACK_BYTES or total > 100 * _PACK_BYTES:
                    done = [(c, k)] if size[0] > _PACK_BYTES else list(held)
                    yield pa.RecordBatch.from_pylist([row(key, *held[key][:2]) for key in done], schema=schema)
                    for key in done:
                        total -= held.pop(key)[2][0]
        if held:
            yield pa.RecordBatch.from_pylist([row(key, *own[:2]) for key, own in held.items()], schema=schema)

    return pack


def _unpacked(table: pa.Table) -> list[str | None]:
    texts: list[str | None] = []
    for sizes, packed in zip(table["sizes"].to_pylist(), table["texts"].to_pylist()):
        raw, at = zstandard.decompress(packed), 0
        for n in np.frombuffer(sizes, np.int32).tolist():
            texts.append(raw[at : at + n].decode("utf-8", "surrogatepass") if n >= 0 else None)
            at += max(n, 0)
    return texts


def _count(n_ranges: int):
    def counted(table: pa.Table) -> pa.Table:
        chunk = Chunk(_unpacked(table))
        cuts = chunk.cuts(n_ranges)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "range": pa.array(full, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * len(full), pa.int32()),
            "kind": pa.array([table["kind"][0].as_py()] * len(full), pa.int32()),
            "keys": pa.array([_planes(chunk.keys[cuts[r] : cuts[r + 1]]) for r in full], pa.binary()),
            "counts": pa.array([_planes(chunk.counts[cuts[r] : cuts[r + 1]].astype(np.uint32)) for r in full], pa.binary()),
        })

    return counted


_ANSWER = "chunk int, range int, shared binary, seen binary, apart binary, tokens long, words long, tokens_kept long, words_kept long"


def _merge(table: pa.Table) -> pa.Table:
    """Sum every key of a range, answer the chunks, and give the range's totals."""
    blocks = [_numbers(k, np.uint64) for k in table["keys"].to_pylist()]
    kinds, chunks = table["kind"].to_pylist(), table["chunk"].to_pylist()
    sizes = np.array([len(b) for b in blocks])
    keys, at, holders = np.unique(np.concatenate(blocks), return_inverse=True, return_counts=True)
    counts = np.concatenate([_numbers(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.float64)
    kind = np.repeat(kinds, sizes)
    summed = lambda mask: np.bincount(at[mask], weights=counts[mask], minlength=len(keys)).astype(np.int64)
    seen, apart = summed(kind != _HELD), summed(kind == _DELETED)
    shared = holders > 1
    rows, low, hash_range = [], 0, table["range"][0].as_py()
    for chunk, size, chunk_kind in zip(chunks, sizes, kinds):
        own = at[low : low + size]
        mask, low = shared[own], low + size
        own = own[mask]
        if len(own):
            # only the chunks of deleted texts need to know what to take out
            out = _planes(apart[own]) if chunk_kind == _DELETED else None
            rows.append((chunk, hash_range, np.packbits(mask).tobytes(), _planes(seen[own]), out, 0, 0, 0, 0))
    is_word = ((keys & _U64(1)) == 0) & (keys != _START & ~_U64(1))
    kept = seen - apart
    rows.append((None, hash_range, b"", b"", b"", *(int(f(x[is_word])) for x in (seen, kept) for f in (np.sum, np.count_nonzero))))
    names = [c.split()[0] for c in _ANSWER.split(", ")]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _single(count: np.ndarray, tokens: int, words: int) -> np.ndarray:
    """Smoothed estimate of a word alone; one place is left for unknown words."""
    return (count + 1) / (tokens + words + 1)


def _bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context frequency; 0 is a context never seen."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def mixture_weights(rows: list[tuple[int, float, int]], rounds: int = 200) -> np.ndarray:
    """Expectation maximisation of each bucket's weight. A row is (bucket, ratio of
    the pair's estimate to the word's, number of held-out tokens). Buckets without
    tokens take the weight of the next lower bucket, the lowest 0."""
    weights = np.zeros(66)
    for bucket in range(1, 66):
        own = [(r, n) for b, r, n in rows if b == bucket]
        if not own:
            weights[bucket] = weights[bucket - 1]
            continue
        ratio, n = np.array([r for r, _ in own]), np.array([n for _, n in own], dtype=np.float64)
        w = 0.5
        for _ in range(rounds):
            new = float((n * w * ratio / (w * ratio + 1 - w)).sum() / n.sum())
            new = min(max(new, 1e-6), 1 - 1e-6)
            if abs(new - w) < 1e-9:
                break
            w = new
        weights[bucket] = w
    return weights


@dataclass(frozen=True)
class Model:
    """Texts dealt in chunks, the answers each chunk got, the totals, and the
    weight of each bucket of context frequency."""

    texts: DataFrame
    answers: DataFrame
    n_ranges: int
    tokens: int
    words: int
    weights: np.ndarray


def fit(docs: DataFrame, held_out: Column, deleted: Column, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> Model:
    """``held_out`` texts are only scored; ``deleted`` ones are the held-out counts
    that the weights are learned on, and count as training texts afterwards."""
    kind = F.when(held_out, _HELD).when(deleted, _DELETED).otherwise(_LEARN)
    rows = docs.select("doc_id", "text", kind.alias("kind"))
    sizes = {r["kind"]: r["size"] for r in rows.groupBy("kind").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("size")).collect()}
    chunk, first = F.lit(0), 0
    for k, size in sorted(sizes.items()):
        n = -(-size // chunk_bytes)
        chunk, first = F.when(F.col("kind") == k, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) + first).otherwise(chunk), first + n
    id_type = docs.schema["doc_id"].dataType
    texts = rows.withColumn("chunk", chunk.cast("int")).mapInArrow(
        _packed(to_arrow_type(id_type)), f"chunk int, kind int, ids array<{id_type.simpleString()}>, sizes binary, texts binary"
    )
    n_ranges = max(1, -(-sum(sizes.values()) // range_bytes))
    blocks = texts.groupBy("chunk").applyInArrow(_count(n_ranges), "range int, chunk int, kind int, keys binary, counts binary")
    answers = reliable(blocks.groupBy("range").applyInArrow(_merge, _ANSWER))
    sums = answers.where(F.col("chunk").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "tokens_kept", "words_kept")]).first()
    answers = answers.where(F.col("chunk").isNotNull()).select("chunk", "range", "shared", "seen", "apart")
    kept, known = sums["tokens_kept"], sums["words_kept"]

    def ratios(table: pa.Table, found: pa.Table) -> pa.Table:
        """Held-out tokens of a chunk by bucket and by the ratio of the two
        estimates, both without the deleted texts."""
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "step": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        own = Chunk(_unpacked(table))
        (seen, seen_pairs), (apart, apart_pairs) = own.totals(_DELETED, found, n_ranges)
        word, pair = seen - apart, seen_pairs - apart_pairs
        n = np.bincount(own.pair, minlength=len(pair))
        bucket = _bucket(word[own.first])
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.log2(pair / word[own.first]) - np.log2(_single(word[own.second], kept, known))
        use = bucket > 0
        bucket, log, n = bucket[use], np.where(pair[use] > 0, log[use], -200.0), n[use]
        step = np.floor(log * _FINE).astype(np.int64)
        code, at = np.unique(bucket * 100_000 + step + 50_000, return_inverse=True)
        return pa.table({
            "bucket": pa.array(code // 100_000, pa.int32()), "step": pa.array(code % 100_000, pa.int32()),
            "n": pa.array(np.bincount(at, weights=n).astype(np.int64)), "log": pa.array(np.bincount(at, weights=n * log)),
        })

    apart = texts.where(F.col("kind") == _DELETED).groupBy("chunk").cogroup(_of(answers, sizes, _DELETED, chunk_bytes).groupBy("chunk"))
    steps = apart.applyInArrow(ratios, "bucket int, step int, n long, log double").groupBy("bucket", "step").agg(F.sum("n").alias("n"), F.sum("log").alias("log"))
    # at most 65 buckets of some thousand steps, whatever the corpus
    weights = mixture_weights([(r["bucket"], 2.0 ** (r["log"] / r["n"]) if r["log"] / r["n"] > -199 else 0.0, r["n"]) for r in steps.collect()])
    return Model(texts, answers, n_ranges, sums["tokens"], sums["words"], weights)


def _of(answers: DataFrame, sizes: dict, kind: int, chunk_bytes: int) -> DataFrame:
    """Answers to the chunks of one kind."""
    first = sum(-(-s // chunk_bytes) for k, s in sizes.items() if k < kind)
    return answers.where((F.col("chunk") >= first) & (F.col("chunk") < first - (-sizes.get(kind, 0) // chunk_bytes)))


def score(model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every
    text; scores are log10 probabilities of the whole text with its end."""
    tokens, words, weights, n_ranges = model.tokens, model.words, model.weights, model.n_ranges
    id_type = model.texts.schema["ids"].dataType.elementType
    id_arrow = to_arrow_type(id_type)

    def scored(table: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (id_arrow, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        kind = table["kind"][0].as_py()
        own = Chunk(_unpacked(table))
        (word, pair), _ = own.totals(kind, found, n_ranges)
        single = _single(word, tokens, words)
        context = word[own.first]
        w = weights[_bucket(context)]
        mixed = w * pair / np.maximum(context, 1) + (1 - w) * single[own.second]
        per_text = lambda x: np.add.reduceat(x, own.begin)
        n = len(own.sizes)
        return pa.table([
            pa.array([i for ids in table["ids"].to_pylist() for i in ids], id_arrow), pa.array([kind == _HELD] * n), pa.array(own.sizes, pa.int64()),
            pa.array(per_text((word > 0).astype(np.int64)[own.word])), pa.array([tokens] * n, pa.int64()),
            pa.array(per_text(np.log10(single)[own.word])), pa.array(per_text(np.log10(mixed)[own.pair])),
        ], names=names)

    return model.texts.groupBy("chunk").cogroup(model.answers.groupBy("chunk")).applyInArrow(
        scored, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )

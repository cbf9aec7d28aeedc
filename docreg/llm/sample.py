"""Bounded samples of labelled documents, and the small fits made on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.llm.base import pieces

#: A sampled text is at most so many characters long, so a sample has a size bound.
LONGEST = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, per_class: int) -> tuple[list[tuple[str, object]], dict]:
    """About ``per_class`` (text, label) rows of each value of a label, chosen by
    the hash of the id among the rows that may be learned from. Rows without id,
    label or text are left out; a repeated label row counts once. Also the number of rows of each value
    before sampling."""
    known = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], {}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("label") == F.lit(k), F.lit(min(1.0, per_class / n))) for k, n in sizes.items()])
    # about per_class ids for each of a handful of values: a size bound for the hint
    chosen = F.broadcast(known.where(draw < share))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    found = rows.select("text", "label").limit(2 * per_class * len(sizes)).collect()
    return sorted({(r["text"], r["label"]) for r in found}, key=lambda x: (str(x[1]), x[0])), sizes


def filtered(docs: DataFrame, model, keep: Callable[[np.ndarray], np.ndarray], piece_bytes: int = 6_000_000) -> DataFrame:
    """The rows whose score by ``model`` is to be kept, unchanged and in place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", piece_bytes):
                yield part.filter(pa.array(keep(model.score(*model.mark(part.column("text").to_pylist())))))

    return docs.mapInArrow(rows, docs.schema)


def share_of_ones(sizes: dict) -> float:
    """Share of label 1 among all rows that may be learned from."""
    return sizes.get(1, 0) / max(1, sum(sizes.values()))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) of a logistic regression by Newton steps. The sample
    weighs as if a share ``prior`` of it had label 1. More evidence never lowers
    the probability: a column that would get a negative weight gets 0."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
        return w
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / len(y) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / (1e-9 + np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    least = int(w[:-1].argmin()) if len(w) > 1 else -1
    if least >= 0 and w[least] < 0:
        return np.insert(logistic(np.delete(x[:, :-1], least, axis=1), y, prior, ridge, rounds), least, 0.0)
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

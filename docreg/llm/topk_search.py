"""Exact top-k search by inner product, term at a time.

Components become whole numbers. A block of candidates is held as postings: for
each component (term), the candidates where it is not 0 and their weights. The
non-zero components of a query scatter their weighted postings into one dense
array of scores per candidate block; the best k of the block are selected by
partition, and the blocks' winners are merged per query. Queries and candidates
are dealt in blocks of bounded size, so a task holds one block of each.

Defined results: vectors that are null or hold a null or non-finite component take
no part, neither do rows without an id; every other row is a candidate for all rows
but itself, so rows that repeat a ``vec_id``, with the same vector or another, are
candidates of each other and queries each for itself; a shorter vector counts as 0 beyond its
end, and an empty one scores 0; an empty table gives no rows. Scores must fit a
64-bit integer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreg.common import reliable

QUERY_BLOCK = 16_384
CANDIDATE_BLOCK = 4_096
#: Queries whose score arrays are filled side by side.
_SIDE = 32
_RESULT = "query_row long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, w): floor(scale * x) of each component, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    weights = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), weights.alias("w"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of different length as one matrix, filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.int64)
    sizes = np.diff(np.asarray(column.offsets, dtype=np.int64))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(queries: pa.Table, rows: pa.Table, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per query its row, its id, and the ids and scores of the block's best."""
    width = max((len(x) for t in (queries, rows) for x in t["w"]), default=0)
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, found = ids[order], _matrix(rows["w"], width)[order]
    place_of = {row: i for i, row in enumerate(rows["row"].to_numpy()[order].tolist())}
    asked, asked_ids, asked_rows = _matrix(queries["w"], width), queries["vec_id"].to_numpy(), queries["row"].to_numpy()
    n = len(ids)
    large = int(np.abs(found).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(1, width)
    kind = np.int32 if large < 2**31 else np.int64
    asked = asked.astype(kind)
    postings = []
    for t in range(width):
        at = np.flatnonzero(found[:, t])
        # a term that nearly all candidates hold is kept as a whole column
        postings.append((slice(None), found[:, t].astype(kind)) if 2 * len(at) > n else (at, found[at, t].astype(kind)))
    for low in range(0, len(asked), _SIDE):
        block = asked[low : low + _SIDE]
        scores = np.zeros((len(block), n), dtype=kind)
        for t in np.flatnonzero(block.any(axis=0)):
            at, weights = postings[t]
            if len(weights) == 0:
                continue
            if isinstance(at, slice):
                scores += block[:, t, None] * weights
            else:
                holds = np.flatnonzero(block[:, t])
                scores[np.ix_(holds, at)] += block[holds, t, None] * weights
        for row, query_id, query_row in zip(scores, asked_ids[low : low + _SIDE], asked_rows[low : low + _SIDE].tolist()):
            own = place_of.get(query_row)
            at = np.arange(n) if own is None else np.delete(np.arange(n), own)
            row = row[at].astype(np.int64)
            if len(row) > k:
                # the k-th best score; of its ties the smallest ids, which come first
                bar = np.partition(row, len(row) - k)[len(row) - k]
                above, tied = np.flatnonzero(row > bar), np.flatnonzero(row == bar)
                keep = np.concatenate([above, tied[: k - len(above)]])
                at, row = at[keep], row[keep]
            yield np.full(len(at), query_row), np.full(len(at), query_id), ids[at], row


def top_k(vectors: DataFrame, is_query=None, k: int = 20, scale: int = 64, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The ``k`` highest scores of each query against all other rows:
    (query_id, rank, vec_id, score), ties to the smaller vec_id. ``is_query`` is a
    condition on ``vec_id``; by default every row whose id is divisible by 20."""
    # rows are numbered in what is written, so a number stays with its row
    rows = reliable(whole_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id()))
    queries = rows.where(F.col("vec_id") % 20 == 0 if is_query is None else is_query)
    sizes = rows.select(F.count("*").alias("n")).union(queries.select(F.count("*"))).collect()
    row_blocks, query_blocks = (max(1, -(-s["n"] // b)) for s, b in zip(sizes, (candidate_block, query_block)))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("row", "vec_id", "w", block(query_blocks).alias("qb"), every(row_blocks).alias("cb"))
    right = rows.select("row", "vec_id", "w", block(row_blocks).alias("cb"), every(query_blocks).alias("qb"))

    def scored(queries: pa.Table, rows: pa.Table) -> pa.Table:
        parts = list(_best(queries, rows, k)) if queries.num_rows and rows.num_rows else []
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_row", "query_id", "vec_id", "score"])

    partial = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(scored, _RESULT)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Token counts by an exact histogram of encoded lengths.

Every text is encoded whole; documents are then aggregated by their number of
tokens. Suffix sums over that histogram answer every context limit at once: how
many documents are longer, how many tokens are kept when texts are cut at the
limit, how many are lost. Suffix sums are taken inside ranges of lengths and
shifted by the totals of the longer ranges.

Defined results: a null or empty text has length 0 and is counted; special
tokens are ordinary text; repeated rows count each; an empty table gives no
rows."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreg.common import reliable

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public vocabulary cuts a text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that share one range of suffix sums.
RANGE = 4096


def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every document. ``vocabulary`` is a file that is
    installed at the same place on every machine."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lengths, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct length, with the suffix sums that answer a limit of
    that length: documents and tokens of it, documents and tokens at least as
    long, and the tokens kept and lost if every text is cut there."""
    base = lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    # written, as it is read twice below and encoding is what costs
    base = reliable(base.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("part", F.floor(F.col("n_tokens") / RANGE)))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = base.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for each 4096 lengths: few, whatever the number of documents
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in "dt"],
                         *[F.sum(c).over(Window.partitionBy()).alias(f"all_{c}") for c in "dt"])
    inside = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = base.join(parts, "part").select(
        "n_tokens", "n_docs", "tokens", "all_d", "all_t",
        (F.sum("n_docs").over(inside) + F.col("later_d")).alias("docs_from"), (F.sum("tokens").over(inside) + F.col("later_t")).alias("tokens_from"),
    )
    kept = F.col("all_t") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")
    return summed.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", kept.alias("kept_at_limit"), (F.col("all_t") - kept).alias("lost_at_limit"),
        (F.col("all_d") - F.col("docs_from") + F.col("n_docs")).alias("docs_up_to"), F.col("all_d").alias("all_docs"), F.col("all_t").alias("all_tokens"),
    )


def kept_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any context limits, also for lengths that no document has: the
    next longer length of the histogram has the suffix sums that hold there. One
    partially combined aggregate; an empty histogram gives no rows."""
    each = histogram.select("*", F.explode(F.array(*[F.lit(int(n)).cast("long") for n in limits])).alias("max_tokens"))
    longer = F.when(F.col("n_tokens") >= F.col("max_tokens"), F.struct("n_tokens", "docs_from", "tokens_from"))
    found = each.groupBy("max_tokens").agg(F.min(longer).alias("s"), F.max("all_tokens").alias("all_tokens"))
    docs, tokens = F.coalesce("s.docs_from", F.lit(0)), F.coalesce("s.tokens_from", F.lit(0))
    kept = F.col("all_tokens") - tokens + docs * F.col("max_tokens")
    return found.select("max_tokens", docs.alias("docs_from"), kept.alias("kept"), (F.col("all_tokens") - kept).alias("lost"))


def quantile(histogram: DataFrame, q: float) -> Column:
    """Aggregate over a histogram: the smallest length that at least a part ``q``
    of the documents does not exceed."""
    return F.min(F.when(F.col("docs_up_to") >= F.ceil(F.lit(q) * F.col("all_docs")), F.col("n_tokens")))

"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``window`` consecutive words. Its fingerprint is the least hash among
its k-grams, so equal windows have equal fingerprints, and neighbouring windows
mostly share theirs: a text keeps about two fingerprints in seven words. First,
the distinct fingerprints of every document meet those of the benchmark; a
document that shares none holds no window. Then hits are extended: in the
documents left, every window is compared word for word, and overlapping
occurrences are joined to spans. No window of the benchmark can be missed, and
none is reported that is not there.

Benchmark items with fewer words than a window are one window of their own
length; their fingerprints are built the same way for that length (one hash below
``k`` words).

Defined results: null texts and texts without words have no windows and are never
hit; rows of the benchmark that repeat an id are parts of one item, and a null
item id counts as the empty text; every row of the documents gives one row and is
judged by its own text, also if ids or whole rows repeat or ids are null; an empty
benchmark hits nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.common import computed, reliable
from docreg.llm.base import ascii_lower, sent

WINDOW, GRAM = 10, 5
#: Runs of ASCII characters that belong to no word, after lower-casing.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts that still hold capitals.
_RAW_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _GAPS), "")


def _starts(words: Column, length: int) -> Column:
    """Start of every window of a length, from 1."""
    return F.sequence(F.lit(1), F.size(words) - (length - 1))


def _fingerprints(df: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """Column ``prints``: distinct fingerprints of the windows of each length."""
    none = F.array().cast("array<bigint>")
    grams = sorted({min(gram, n) for n in lengths})

    def hashes(k: int) -> Column:
        each = F.transform(_starts(F.col("words"), k), lambda i: F.xxhash64(F.slice("words", i, k)))
        return F.when(F.size("words") >= k, each).otherwise(none).alias(f"hash{k}")

    hashed = computed(df, *[hashes(k) for k in grams])

    def least(n: int) -> Column:
        k = min(gram, n)
        of = lambda i: F.array_min(F.slice(f"hash{k}", i, n - k + 1))
        # windows of another length than the usual are kept apart
        own = of if n == max(lengths) else lambda i: F.xxhash64(of(i), F.lit(n))
        return F.when(F.size("words") >= n, F.transform(_starts(F.col("words"), n), own)).otherwise(none)

    found = hashed.withColumn("prints", F.array_distinct(F.concat(*[least(n) for n in lengths])))
    return found.drop(*[f"hash{k}" for k in grams])


def _windows(words: Column, lengths: list[int]) -> Column:
    """Every window of each length: its start from 0, its length, its words."""

    def each(n: int) -> Column:
        found = F.transform(_starts(words, n), lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("words")))
        return F.when(F.size(words) >= n, found).otherwise(F.array().cast("array<struct<at:int,n:int,words:string>>"))

    return F.concat(*[each(n) for n in lengths])


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, gram: int) -> DataFrame:
    """(hit_id, hit_row, spans, items) of every id and text with a hit; ``hit_row``
    is the hash of both."""
    items = computed(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), words_of(F.col("text")).alias("words"))
    items = reliable(items.where(F.size("words") > 0).select("item_id", "words"))
    short = [r["n"] for r in items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect()]
    lengths = [window, *sorted(short)]  # at most ``window`` values
    own = F.size("words")
    parts = [items.where(own >= window), *[items.where(own == n) for n in lengths[1:]]]
    cut, prints = [], []
    for part, n in zip(parts, lengths):
        cut.append(part.select("item_id", F.inline(_windows(F.col("words"), [n]))))
        # of all lengths, so that the usual one is known as such
        prints.append(_fingerprints(part, lengths, gram).select(F.explode("prints").alias("print")))
    union = lambda all_: all_[0] if len(all_) == 1 else all_[0].unionByName(union(all_[1:]))
    cut = reliable(union(cut).select("item_id", "n", "words").distinct())
    prints = reliable(union(prints).distinct())

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    worded = computed(keyed, words_of(F.col("text")).alias("words")).drop("text")
    printed = _fingerprints(worded, lengths, gram).select("row", F.explode("prints").alias("print"))
    suspects = reliable(printed.join(sent(prints), "print", "left_semi").select("row").distinct())
    held = keyed.join(sent(suspects), "row", "left_semi")
    held = computed(held, words_of(F.col("text")).alias("words")).select("doc_id", "row", F.inline(_windows(F.col("words"), lengths)))
    hits = held.join(sent(cut), ["n", "words"]).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("n")).alias("end")))).alias("at"), F.sort_array(F.collect_set("item_id")).alias("items")
    )
    # overlapping and touching occurrences become one span
    first = F.get("at", F.lit(0))
    joined = F.aggregate(
        "at", F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), first["at"].alias("start"), first["end"].alias("end")),
        lambda s, x: F.when(x["at"] <= s["end"], F.struct(s["done"].alias("done"), s["start"].alias("start"), F.greatest(s["end"], x["end"]).alias("end")))
        .otherwise(F.struct(F.concat(s["done"], F.array(F.struct(s["start"], s["end"]))).alias("done"), x["at"].alias("start"), x["end"].alias("end"))),
        lambda s: F.concat(s["done"], F.array(F.struct(s["start"], s["end"]))),
    )
    return reliable(hits.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row"), joined.alias("spans"), "items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, spans, items). ``spans`` are
    the joined hit spans as (start, end) in words, ``items`` the ids, as text, of
    the benchmark items with a window in the document."""
    hits = _hits(docs, benchmark, window, gram)
    counted = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"),
        F.coalesce(F.size(F.array_remove(F.split("text", _RAW_GAPS), "")), F.lit(0)).alias("n_words"),
    ).withColumn("n_words", F.greatest("n_words", F.lit(0)).cast("long"))
    found = counted.join(sent(hits), (F.col("row") == F.col("hit_row")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return found.select(
        "doc_id", "n_words", F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns. Only rows whose own text
    is hit go, whatever other rows of their id or without id hold."""
    hit = _hits(docs, benchmark, WINDOW, GRAM).select("hit_id", "hit_row")
    own = (F.xxhash64(docs["doc_id"], docs["text"]) == hit["hit_row"]) & docs["doc_id"].eqNullSafe(hit["hit_id"])
    return docs.join(sent(hit), own, "left_anti")


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

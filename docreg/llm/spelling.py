"""Spelling variants: words one edit apart, found by pivotal grams.

Words are counted inside the tasks before they are shuffled. Grams are the bigrams of
a word with their places, ordered from rare to common over all words. One edit touches
at most one of two grams that do not overlap. So each word chooses, by dynamic
programming over its rarest grams, two disjoint ones that are cheapest to look up: its
pivots. Of two words one edit apart, take the one whose
rarest grams end earlier in the order: one of its pivots is whole in the other word,
and among the other's rarest grams too.

The edit lies on one side of that pivot, so on the other side both words agree. The
index therefore holds, for each of a word's rarest grams, the gram with all before it
and the gram with all behind it, by length of the word; a pivot is looked up at its
own place, and only in words that are as long or longer or shorter by one. What is
found is verified by edit distance. Links are counted and ranked by partial
aggregates; forms are followed to their end by doubling.

Frequencies of grams are sent to all tasks: a gram is two letters of the class, so
there are at most 90 * 90 of them.

Defined results: a null text has no words; a null id counts as the empty text in the
hash that damages words; rows with repeated ids are documents of their own; words of
any length are taken whole; ties of frequency go to the gram smaller in code-point
order, ties of forms to the smaller word; an empty table gives no rows; other columns
are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.common import reliable

#: A run of letters once A-Z are lowered.
RUN = "[a-zÀ-ÿ]{%d,}"
#: Shortest word, fewest occurrences, how much more frequent a form is.
SHORTEST, FEWEST, RATIO = 6, 5, 5
#: One word in so many is damaged.
DAMAGE = 199
#: Rarest grams that are indexed; two disjoint ones are always among three.
PREFIX = 4
#: Distinct words that a task counts before it hands them on; longest text cut at once.
_COUNTED, _AT_ONCE = 200_000, 1 << 20


def _words_of(doc_id: str | None, text: str | None, run: re.Pattern, damage: int) -> Iterator[str]:
    lowered = (text or "").encode("utf-8").lower().decode("utf-8")
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = run.findall(lowered) if len(lowered) < _AT_ONCE else (m.group() for m in run.finditer(lowered))
    for word in found:
        h = zlib.crc32(word.encode("utf-8"), begun)
        if h % damage == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        yield word


def counted_words(docs: DataFrame, shortest: int = SHORTEST, damage: int = DAMAGE) -> DataFrame:
    """(word, n) of runs of letters, lower-cased, in places with a letter left out, as
    far as a task has counted them: a word has a row of each task and more. Runs that
    are shorter than a word are none, with or without damage."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, counts = re.compile(RUN % shortest), Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                counts.update(_words_of(doc_id.as_py(), text.as_py(), run, damage))
                if len(counts) > _COUNTED:
                    yield pa.record_batch([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
                    counts = Counter()
        yield pa.record_batch([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(rows, "word string, n long")


def vocabulary(counts: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return counts.where(F.length("word") >= shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _grams(words: DataFrame) -> DataFrame:
    """(word, gram, at) of every bigram."""
    letters = words.select("word", F.split("word", "").alias("letters"))
    # places by cutting the letters up once: a substring per place would walk the word each time
    pairs = F.arrays_zip(F.col("letters"), F.slice("letters", F.lit(2), F.size("letters")))
    each = letters.select("word", F.posexplode(pairs).alias("at", "pair")).select("word", "pair.*", "at").toDF("word", "first", "second", "at")
    return each.where(F.col("second").isNotNull()).select("word", F.concat("first", "second").alias("gram"), (F.col("at") + 1).alias("at"))


def _pivots(rarest: Column) -> Column:
    """Of grams (at, cost) in order of place, the two disjoint ones of least cost: the
    best pair that ends at a gram is that gram and the cheapest before the one it
    overlaps, so one pass keeps the best pair and the cheapest grams so far."""
    least = lambda grams, p: F.array_min(F.transform(F.filter(grams, lambda e: e["at"] <= p - 2), lambda e: F.struct(e["cost"].alias("cost"), e["at"].alias("at"))))
    none = F.lit(None).cast("struct<cost:bigint,first:int,second:int>")

    def step(best: Column, g: Column) -> Column:
        before = least(rarest, g["at"])
        ending = F.when(before.isNotNull(), F.struct((before["cost"] + g["cost"]).alias("cost"), before["at"].alias("first"), g["at"].alias("second")))
        return F.least(best, ending)

    return F.aggregate(rarest, none, step)


def rarest_grams(words: DataFrame) -> DataFrame:
    """(word, last, rarest): the places of the ``PREFIX`` rarest grams and the rank of
    the last of them. Of equal grams the earlier is the rarer; as an edit may move a
    gram by one place, one more right behind the last is listed too."""
    grams = _grams(words)
    often = reliable(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")))
    ranked = grams.join(F.broadcast(often), "gram").groupBy("word").agg(
        F.array_sort(F.collect_list(F.struct("often", "gram", "at"))).alias("grams")
    )
    last = F.col("grams")[F.least(F.lit(PREFIX), F.size("grams")) - 1]
    ranked = ranked.select("word", last.alias("last"), F.slice("grams", 1, PREFIX + 1).alias("grams"))
    moved = lambda g: F.struct(g["often"].alias("often"), g["gram"].alias("gram"), (g["at"] - 1).alias("at"))
    kept = F.filter("grams", lambda g: (g <= F.col("last")) | (moved(g) <= F.col("last")))
    return ranked.select("word", "last", F.transform(kept, lambda g: g["at"]).alias("rarest"))


def _entries(words: DataFrame, places: str) -> DataFrame:
    """(side, part, size, rank, at, last, word): a gram with all before it, and with all
    behind."""
    each = words.select("word", "last", F.length("word").alias("size"), F.posexplode(places).alias("rank", "at"))
    ahead = F.struct(F.lit(0).alias("side"), F.col("word").substr(F.lit(1), F.col("at") + 1).alias("part"))
    behind = F.struct(F.lit(1).alias("side"), F.col("word").substr(F.col("at"), F.col("size")).alias("part"))
    return each.select("word", "last", "size", "rank", "at", F.explode(F.array(ahead, behind)).alias("e")).select("word", "last", "size", "rank", "at", "e.*")


def pivotal_grams(entries: DataFrame) -> DataFrame:
    """(word, last, pivots): the places of the two pivots. A gram costs as many entries
    as share what lies before or behind it."""
    sizes = entries.groupBy("side", "part").agg(F.count(F.lit(1)).alias("cost"))
    own = entries.where(F.col("rank") < PREFIX)
    costs = own.join(sizes, ["side", "part"]).groupBy("word", "last", "at").agg(F.sum("cost").alias("cost"))
    placed = costs.groupBy("word", "last").agg(F.array_sort(F.collect_list(F.struct("at", "cost"))).alias("placed"))
    return placed.select("word", "last", _pivots(F.col("placed")).alias("pair")).select("word", "last", F.array("pair.first", "pair.second").alias("pivots"))


def near_words(words: DataFrame) -> DataFrame:
    """(a, b) of all words one edit apart, in both directions. ``words`` holds each
    word once, of ``SHORTEST`` code points at least."""
    index = reliable(_entries(rarest_grams(words), "rarest"))
    sizes = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")
    asked = _entries(pivotal_grams(index), "pivots").select(F.col("word").alias("a"), F.col("last").alias("last_a"), "side", "part", sizes)
    held = index.select(F.col("word").alias("b"), F.col("last").alias("last_b"), "side", "part", "size")
    found = asked.join(held, ["side", "part", "size"]).where((F.col("last_a") <= F.col("last_b")) & (F.col("a") != F.col("b")))
    near = found.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = reliable(near)
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of each word's chain of forms. The
    number of occurrences rises along a chain, so it has an end, and after k rounds
    2 ** k forms are followed."""
    far = reliable(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reliable(far.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        far = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return far


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    words = reliable(vocabulary(counted_words(docs)))
    near = near_words(words.select("word"))
    # the most frequent near word, of ties the smaller
    best = near.join(words.withColumnRenamed("word", "b"), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("word"))).alias("top")
    )
    top_n = -F.col("top.less")
    fits = top_n >= ratio * F.col("n")
    rows = reliable(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("top.word")).alias("form"), F.when(fits, top_n).alias("form_n"),
    ))
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

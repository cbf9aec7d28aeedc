"""Mixing sources to target weights along a time-varying curriculum, in DataFrame
operations only.

Each source has a weight that runs in a straight line from the start to the end
of training. Its integral over training is the weight that shares the words; a
source takes at most ``most_repeats`` times its words, what it cannot take is
shared again by weight. Inside a source the documents form one stream in hash
order, repeated until the target is reached. Where the stream stands when a
fraction ``t`` of training is over is the integral of its weight up to ``t``, so
a document's training position is the inverse of that integral at its offset.

Defined results: a null text has size 0; null sources form one source, last in
order; a document of size 0 takes nothing and stands where its neighbours in the
stream stand; rows that repeat an id follow each other and each takes its own
words; an empty table gives an empty plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.llm.base import id_text, word_count

#: Weight of a source at the start and at the end of training, by its place in
#: code point order, repeating. The means are 3, 1 and 2.
SCHEDULES = ((4.0, 2.0), (1.0, 1.0), (1.0, 3.0))
#: Documents that one task orders at most, on average.
SLICE_ROWS = 100_000


def _shares(totals: DataFrame, schedules, share: float, most_repeats: int) -> DataFrame:
    """One row per source: weight, lean of its schedule and target. The level is
    found without a loop: in order of the level at which a source is full, the
    first source that is not yet full fixes the level for all that follow."""
    place = F.row_number().over(Window.orderBy(F.col("no_source"), F.col("source"))) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(schedules) + 1).cast("int"))
    means = [(a + b) / 2 for a, b in schedules]
    ranked = totals.select(
        "*", pick(means).alias("weight"), pick([(b - a) / (a + b) for a, b in schedules]).alias("lean"),
        (F.sum("source_size").over(Window.partitionBy()) * F.lit(share)).alias("demand"),
    ).withColumn("cap", (F.col("source_size") * most_repeats).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", "no_source", "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    stepped = ranked.withColumn("level", (F.col("demand") - before) / open_weight).withColumn("step", F.row_number().over(order))
    fits = F.when(F.col("full_at") >= F.col("level"), F.struct("step", "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    return stepped.select(
        "no_source", "source", "source_size", "lean",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"),
    )


def plan_curriculum(
    docs: DataFrame, schedules=SCHEDULES, share: float = 1.5, most_repeats: int = 2, salt: str = "", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """One row per document: size, size and target of its source, the words taken
    of it, and the training position of each of its copies (0 to 1, in the order
    of the copies). The last copy of a source's stream is cut at the target.

    ``source`` order is by code point; ``slice_rows`` only sets how the work is
    split, never the result. A source is ordered in slices of its hash range, so
    a source with most rows is spread over tasks."""
    sized = reliable(docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"),
        word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(salt), id_text(F.col("doc_id"))).cast("binary")).alias("draw"),
    ))
    digits = max(1, math.ceil(math.log(max(1, sized.count() / slice_rows), 16)))
    sized = sized.withColumn("slice", F.substring("draw", 1, digits))
    key = ["no_source", "source"]
    by_slice = reliable(sized.groupBy(*key, "slice").agg(F.sum("size").alias("slice_size")))
    shares = _shares(by_slice.groupBy(*key).agg(F.sum("slice_size").alias("source_size")), schedules, share, most_repeats)
    starts = by_slice.join(shares, key).select(
        *key, "slice", "source_size", "lean", "target",
        F.coalesce(F.sum("slice_size").over(Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    inside = Window.partitionBy(*key, "slice").orderBy("draw", "doc_id", "size")
    placed = sized.join(starts, [*key, "slice"]).withColumn(
        "offset", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    )
    whole = F.floor("target").cast("long")
    rounds = F.sequence(F.lit(0), F.lit(most_repeats - 1))
    words = lambda r: F.greatest(F.least(whole - r * F.col("source_size") - F.col("offset"), F.col("size")), F.lit(0))
    used = (F.lit(1.0) - F.col("lean"))
    part = lambda r: (r * F.col("source_size") + F.col("offset")) / F.nullif(F.col("target"), F.lit(0.0))
    position = lambda r: F.lit(2.0) * part(r) / (used + F.sqrt(used * used + F.lit(4.0) * F.col("lean") * part(r)))
    copies = F.filter(F.transform(rounds, lambda r: F.struct(words(r).alias("words"), position(r).alias("position"))), lambda c: c["words"] > 0)
    return placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target",
        F.aggregate(copies, F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), copies.alias("copies"),
    )


def training_order(plan: DataFrame) -> DataFrame:
    """The mix itself: one row per copy, range-sorted by training position. Ties
    stand in order of id and copy."""
    copies = plan.select("doc_id", "source", F.posexplode("copies").alias("copy", "c"))
    return copies.select("doc_id", "source", "copy", F.col("c.words").alias("words"), F.col("c.position").alias("position")).orderBy("position", "doc_id", "copy")


def mix_digest(docs: DataFrame, *more: str) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy;
    documents that are not taken follow at the end. ``more`` are further columns of
    the plan, such as the copies with the words and the position of each."""
    first = F.get("copies", F.lit(0))["position"]
    return plan_curriculum(docs).select(
        "doc_id", "size", "source_size", "target", "taken", first.alias("position"), *more
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")

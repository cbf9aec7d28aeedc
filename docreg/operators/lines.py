"""Lines: grouping words, line boxes and texts, runs inside a line or band."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg.common import CONF_DIGITS, CONF_SUM, box_height, computed, conf_sum, mean_of_sum
from docreg.functions import text as tx

LINE_SLACK = 4
RUN_GAP = 3
MAX_VALUE_LINES = 2
#: Words of touching lines that are folded as one row.
BLOCK_WORDS = 4096


def _first_fit(keys: list[str], slack: int):
    """Batches sorted by (keys, block, y0, word_no) → the same with ``line_no``.
    Holds only the lines of the current block a later word can still reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reachable, count = None, [], 0
        for batch in batches:
            ids = zip(*(batch.column(k).to_pylist() for k in [*keys, "_block", "_first_line"]))
            spans = zip(batch.column("y0").to_pylist(), batch.column("y1").to_pylist())
            numbers = []
            for this, (top, bottom) in zip(ids, spans):
                if this != block:
                    block, reachable, count = this, [], 0
                reachable = [l for l in reachable if l[1] >= top - slack]
                middle = (top + bottom) / 2
                line = next((l for l in reachable if l[1] >= middle - slack), None)
                if line is None:
                    line = [count, bottom]
                    reachable.append(line)
                    count += 1
                line[1] = max(line[1], bottom)
                numbers.append(this[-1] + line[0])
            kept = [n for n in batch.schema.names if n not in ("_block", "_first_line")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(numbers, pa.int64())], names=[*kept, "line_no"]
            )

    return run


def line_spans(words: DataFrame, keys: Sequence[str] = ("doc_id",), slack: int = LINE_SLACK) -> DataFrame:
    """For every distinct vertical span of a page: its line, and whether its
    block of touching lines holds more than one.

    Only the first word of a span can open a line, so spans, not words, go
    through the page-wide window: their number is bounded by the height of the
    page, whatever number of words it holds."""
    spans = words.groupBy(*keys, "y0", "y1").agg(F.min("word_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return _numbered(spans, list(keys), slack)


def _numbered(spans: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """Spans (``_first`` word, number ``_n`` of words) with line and block."""
    order = Window.partitionBy(*keys).orderBy("y0", "_first")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.col("_reach") + slack
    opens_line = F.col("_reach").isNull() | (F.col("y0") + F.col("y1") > 2 * reach)
    opens_block = F.col("_reach").isNull() | (F.col("y0") > reach)
    numbered = (
        spans.withColumn("_reach", F.max("y1").over(before))
        .withColumn("_opens", opens_line.cast("long"))
        .withColumn("line_no", F.sum("_opens").over(so_far) - 1)
        .withColumn("_block", F.sum(opens_block.cast("long")).over(so_far))
    )
    block = Window.partitionBy(*keys, "_block")
    more = [c for c in spans.columns if c not in (*keys, "y0", "y1", "_first", "_n")]
    return numbered.select(
        *keys, "y0", "y1", *more, "line_no", "_block",
        F.min("line_no").over(block).alias("_first_line"),
        (F.sum("_opens").over(block) > 1).alias("_mixed"), F.sum("_n").over(block).alias("_in_block"),
    )


def _folded_lines(order: Column, slack: int) -> Column:
    """Line numbers, from 0, of the words (y0, y1) of a block in their order: a fold
    whose state is the lines that a later word can still reach, their number so far,
    and the numbers given."""
    line = lambda no, bottom: F.struct(no.cast("int").alias("no"), bottom.cast("int").alias("bottom"))
    start = F.struct(F.array().cast("array<struct<no:int,bottom:int>>").alias("lines"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("given"))

    def step(state: Column, word: Column) -> Column:
        top, bottom = word["y0"], word["y1"]
        reached = F.filter(state["lines"], lambda l: l["bottom"] >= top - slack)
        fits = F.transform(reached, lambda l: l["bottom"] >= (top + bottom) / F.lit(2.0) - slack)
        # a one-element array binds what is used more than once
        found = F.array(F.struct(reached.alias("lines"), F.array_position(fits, F.lit(True)).cast("int").alias("at")))

        def joined(f: Column) -> Column:
            own = F.when(f["at"] > 0, F.get(f["lines"], f["at"] - 1)["no"]).otherwise(state["n"])
            grown = F.transform(f["lines"], lambda l, i: F.when(i + 1 == f["at"], line(l["no"], F.greatest(l["bottom"], bottom))).otherwise(l))
            return F.struct(
                F.when(f["at"] > 0, grown).otherwise(F.concat(f["lines"], F.array(line(state["n"], bottom)))).alias("lines"),
                (state["n"] + F.when(f["at"] > 0, 0).otherwise(1)).alias("n"), F.concat(state["given"], F.array(own)).alias("given"),
            )

        return F.transform(found, joined)[0]

    return F.aggregate(order, start, step, lambda state: state["given"])


def _fold_blocks(touching: DataFrame, keys: list[str], columns: list[str], slack: int) -> DataFrame:
    """The words of touching blocks with their lines, block by block in one row."""
    rest = [c for c in columns if c not in (*keys, "y0", "word_no")]
    blocks = touching.groupBy(*keys, "_block", "_first_line").agg(F.array_sort(F.collect_list(F.struct("y0", "word_no", *rest))).alias("_words"))
    given = blocks.withColumn("_given", _folded_lines(F.col("_words"), slack))
    each = given.select(*keys, "_first_line", F.explode(F.arrays_zip("_words", "_given")).alias("_each"))
    return each.select(*keys, "_each._words.*", (F.col("_first_line") + F.col("_each._given")).cast("long").alias("line_no")).select(*columns, "line_no")


def group_lines(
    words: DataFrame, keys: Sequence[str] = ("doc_id",), slack: int = LINE_SLACK, dealt: bool = False
) -> DataFrame:
    """Add ``line_no`` (from 0, top to bottom): a word, taken by its top, joins
    the first line whose box widened by ``slack`` holds its vertical center, or
    opens a line.

    Where lines stand apart the number follows from the spans alone. Blocks in
    which lines touch depend on the order of their words; those blocks, and only
    those, are folded word by word, a block of ``BLOCK_WORDS`` words at most as one
    row. A larger block is streamed through one task in the same order.

    Words meet their spans in a join, which spreads a page of very many words and moves
    all words for it. With ``dealt`` the pages are dealt out by their keys already: then
    the words pass through the page-wide window themselves, where they lie, and only
    those of long blocks move."""
    keys = list(keys)
    if dealt:
        numbered = _numbered(words.withColumn("_first", F.col("word_no")).withColumn("_n", F.lit(1)), keys, slack)
        alone = numbered.filter(~F.col("_mixed")).select(*words.columns, "line_no")
        mixed = numbered.filter("_mixed").select(*words.columns, "_block", "_first_line", "_in_block")
        return alone.unionByName(_touching_lines(mixed, keys, words.columns, slack))
    on = [*keys, "y0", "y1"]
    spans = line_spans(words, keys, slack)
    apart = words.join(spans.filter(~F.col("_mixed")).select(*on, "line_no"), on).select(*words.columns, "line_no")
    touching = words.join(spans.filter("_mixed").select(*on, "_block", "_first_line", "_in_block"), on)
    return apart.unionByName(_touching_lines(touching, keys, words.columns, slack))


def _touching_lines(touching: DataFrame, keys: list[str], columns: list[str], slack: int) -> DataFrame:
    """Words of touching blocks with their lines: short blocks folded, long ones streamed."""
    folded = _fold_blocks(touching.where(F.col("_in_block") <= BLOCK_WORDS), keys, columns, slack)
    long = touching.where(F.col("_in_block") > BLOCK_WORDS).select(*columns, "_block", "_first_line")
    streamed = long.repartition(*keys, "_block").sortWithinPartitions(*keys, "_block", "y0", "word_no")
    schema = T.StructType([*(long.schema[c] for c in columns), T.StructField("line_no", T.LongType())])
    return folded.unionByName(streamed.mapInArrow(_first_fit(keys, slack), schema))


def gathered_lines(words: DataFrame, keys: Sequence[str] = ("doc_id",), slack: int = LINE_SLACK) -> DataFrame:
    """One row per line of ``group_lines``: its number, top, bottom and ``words`` from
    left to right, for all that makes one value of a line. Words are gathered by span
    before lines are known, so they are not joined with their lines: where lines stand
    apart a word is moved once, or not at all if the pages are dealt out already."""
    keys = list(keys)
    rest = [c for c in words.columns if c not in (*keys, "x0", "word_no", "text", "y0", "y1")]
    item = F.struct("x0", "word_no", "text", *rest)
    listed = words.groupBy(*keys, "y0", "y1").agg(F.collect_list(item).alias("_items"))
    first = F.array_min(F.transform("_items", lambda w: w["word_no"]))
    spans = _numbered(listed.select("*", first.alias("_first"), F.size("_items").alias("_n")), keys, slack)
    apart = spans.filter(~F.col("_mixed")).groupBy(*keys, "line_no").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_sort(F.flatten(F.collect_list("_items"))).alias("words")
    )
    each = spans.filter("_mixed").select("*", F.explode("_items").alias("_item")).select(
        *keys, "y0", "y1", "_item.*", "_block", "_first_line", "_in_block"
    )
    numbered = _touching_lines(each, keys, words.columns, slack)
    touching = numbered.groupBy(*keys, "line_no").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(item)).alias("words")
    )
    return apart.unionByName(touching)


def _texts() -> Column:
    return F.array_join(F.transform("words", lambda w: w["text"]), " ")


def _conf_total() -> Column:
    """Exact sum of the confidences of a line's words, of the type of ``conf_sum``."""
    zero = F.lit(0).cast(CONF_SUM)
    known = F.filter(F.transform("words", lambda w: w["conf"].cast(CONF_DIGITS)), lambda c: c.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, zero, lambda s, c: (s + c).cast(CONF_SUM)))


def boxed_lines(words: DataFrame, keys: Sequence[str] = ("doc_id",), slack: int = LINE_SLACK) -> DataFrame:
    """``line_boxes`` of ``group_lines``, without a join of words and lines."""
    side = lambda of, c: of(F.transform("words", lambda w: w[c])).alias(c)
    return gathered_lines(words, keys, slack).select(
        *keys, "line_no", side(F.array_min, "x0"), "y0", side(F.array_max, "x1"), "y1", _texts().alias("text"),
        F.size("words").cast("long").alias("n_words"), mean_of_sum(_conf_total(), F.size("words")).alias("conf"),
    ).withColumn("height", box_height())


def joined_text(order: Sequence[str], text: str = "text", separator: str = " ") -> Column:
    """Aggregate: the texts of a group in the given order."""
    items = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(items, lambda i: i[text]), separator)


def line_boxes(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per line: box, height (at least 1), text and mean confidence."""
    return lines.groupBy(*keys, "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        joined_text(["x0", "word_no"]).alias("text"),
        F.count(F.lit(1)).alias("n_words"),
        mean_of_sum(conf_sum(), F.count(F.lit(1))).alias("conf"),
    ).withColumn("height", box_height())


def rebuild_text(words: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Text of a page or region: lines top to bottom, words left to right."""
    lines = gathered_lines(words, keys).select(*keys, "line_no", _texts().alias("text"))
    return lines.groupBy(*keys).agg(joined_text(["line_no"]).alias("text"))


def strip_inline_label(words: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Value of a label-and-value line: what follows the widest gap (of equal
    gaps the rightmost). A lone word is the value. The value is one text, so a
    group is never larger than one value may be."""
    order = Window.partitionBy(*keys).orderBy("x0", "word_no")
    here = F.struct("x0", "word_no")
    gapped = words.withColumn("_gap", F.lead("x0").over(order) - F.col("x1"))
    widest = F.max(F.when(F.col("_gap").isNotNull(), F.struct("_gap", "x0", "word_no")))
    split = gapped.withColumn("_split", widest.over(Window.partitionBy(*keys)))
    after = F.col("_split").isNull() | (here > F.struct("_split.x0", "_split.word_no"))
    return split.filter(after).groupBy(*keys).agg(joined_text(["x0", "word_no"]).alias("value"))


def column_run(words: DataFrame, keys: Sequence[str] = ("doc_id",), k: int = RUN_GAP) -> DataFrame:
    """Words from the left up to the first one further than ``k`` times its own
    height from everything before it.

    Only the first word of a place (left, right, height) can be that far, so
    distinct places, not words, go through the window; their number is bounded
    by the pixels of the band."""
    keys = list(keys)
    places = words.groupBy(*keys, "x0", "x1", box_height().alias("_height")).agg(F.min("word_no").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("x0", "_first").rowsBetween(Window.unboundedPreceding, -1)
    jumps = places.withColumn("_reach", F.max("x1").over(before)).filter(F.col("x0") - F.col("_reach") > k * F.col("_height"))
    cuts = jumps.groupBy(*keys).agg(F.min(F.struct("x0", F.col("_first").alias("word_no"))).alias("_cut"))
    run = words.join(cuts, keys, "left").filter(F.col("_cut").isNull() | (F.struct("x0", "word_no") < F.col("_cut")))
    return run.select(*words.columns)


def value_lines(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of a band with what the selection below needs to know of them."""
    items = F.array_sort(F.collect_list(F.struct("x0", "word_no", "text")))
    listed = group_lines(words, keys).groupBy(*keys, "line_no").agg(
        F.transform(items, lambda i: i["text"]).alias("_words"),
        conf_sum().alias("conf_total"),
        F.count(F.lit(1)).alias("n_words"),
    )
    joined = computed(listed, F.array_join("_words", " ").alias("text"))
    looks = [
        tx.is_label_like("text", "_words").alias("is_label"),
        tx.is_date_like(F.array_join("_words", "")).alias("is_date"),
    ]
    return computed(joined, *looks).drop("_words")


def select_value_lines(
    lines: DataFrame, keys: Sequence[str] = ("doc_id",), skip_leading: Column | bool = False
) -> DataFrame:
    """The value lines of a band: from the top to the first line that looks like
    a label or a date, two at most. With ``skip_leading``, label-like lines at
    the top are passed over and the first other line always counts."""
    skip = F.lit(skip_leading) if isinstance(skip_leading, bool) else skip_leading
    band = Window.partitionBy(*keys)
    so_far = band.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(~skip | ~F.col("is_label"), F.col("line_no"))).over(band)
    stops = (F.col("is_label") | F.col("is_date")) & ~(skip & (F.col("line_no") == F.col("_first")))
    return (
        lines.withColumn("_first", first)
        .filter(F.col("line_no") >= F.col("_first"))
        .withColumn("_stopped", F.max(stops).over(so_far))
        .withColumn("_rank", F.row_number().over(band.orderBy("line_no")))
        .filter(~F.col("_stopped") & (F.col("_rank") <= MAX_VALUE_LINES))
        .drop("_first", "_stopped", "_rank")
    )


def value_of(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One read per band: text without Arabic runs, mean confidence over its words."""
    return lines.groupBy(*keys).agg(
        tx.prefer_latin(joined_text(["line_no"])).alias("value"),
        mean_of_sum(F.sum("conf_total"), F.sum("n_words")).alias("conf"),
    )

"""Operators on word tables: page key, ``word_no``, text, confidence and box."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg.common import blank, center_y, col, mean_conf, reliable
from docreg.functions import text as tx

MIN_CONFIDENCE = 0.60
MIN_OVERLAP = 0.5

# When a page counts as lying on its side.
SIDEWAYS_MIN_LENGTH = 3
SIDEWAYS_MIN_WORDS = 3
SIDEWAYS_ASPECT = 1.3
SIDEWAYS_SHARE = 0.6

#: Height of the slices a page is cut into, so that no step takes a whole page.
SLICE = 64


def filter_confident(words: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    return words.filter(F.col("conf") >= min_conf)


def strip_arabic(words: DataFrame) -> DataFrame:
    """Drop Arabic script from the words; a word with nothing left goes."""
    return words.withColumn("text", tx.strip_arabic("text")).filter(~blank("text"))


def flag_reads(reads: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """Mark reads for review: low mean confidence, no value, or a side of the
    document that could not be aligned (optional column ``unaligned``)."""
    doubt = (F.col("conf") < min_conf) | blank("value")
    if "unaligned" in reads.columns:
        doubt = doubt | F.coalesce(F.col("unaligned"), F.lit(False))
    return reads.withColumn("flagged", doubt)


def avg_confidence(words: DataFrame, pages: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Mean word confidence per page; a page without words has 0.0."""
    means = words.groupBy(*keys).agg(mean_conf().alias("avg_conf"))
    return pages.select(*keys).join(means, list(keys), "left").withColumn(
        "avg_conf", F.coalesce("avg_conf", F.lit(0.0))
    )


def rotated_pages(words: DataFrame, keys: Sequence[str] = ("doc_id",), pages: DataFrame | None = None) -> DataFrame:
    """Pages whose words are mostly taller than wide. With ``pages``, a page
    without words has a row too: it is not rotated."""
    long_word = F.length("text") >= SIDEWAYS_MIN_LENGTH
    tall = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0")) * F.lit(SIDEWAYS_ASPECT)
    counts = words.groupBy(*keys).agg(
        F.count_if(long_word).alias("n_words"), F.count_if(long_word & tall).alias("n_tall")
    )
    sideways = (F.col("n_words") >= SIDEWAYS_MIN_WORDS) & (F.col("n_tall") >= F.col("n_words") * F.lit(SIDEWAYS_SHARE))
    if pages is not None:
        none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_words", "n_tall")]
        counts = pages.select(*keys).distinct().join(counts, list(keys), "left").select(*keys, *none)
    return counts.withColumn("rotated", sideways)


def words_in_bands(words: DataFrame, bands: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Words whose vertical center lies in a band ``y_lo..y_hi`` of their page
    and, where the band has ``x_lo``, that start at or right of it.

    Pages are cut into slices of equal height and joined on (page, slice), so a
    page with very many words is spread over tasks and no pair of word and band
    further apart than one slice is ever formed."""
    sliced = bands.withColumn(
        "_slice", F.explode(F.sequence(F.floor(F.col("y_lo") / SLICE), F.floor(F.col("y_hi") / SLICE)))
    )
    placed = words.withColumn("_slice", F.floor(center_y() / SLICE))
    inside = center_y().between(F.col("y_lo"), F.col("y_hi"))
    if "x_lo" in bands.columns:
        inside = inside & (F.col("x0") >= F.col("x_lo"))
    return placed.join(sliced, [*keys, "_slice"]).filter(inside).drop("_slice")


def _overlap(a: str, b: str):
    """Intersection over union of two boxes; 0 when they do not meet."""
    c = lambda side, name: F.col(f"{side}.{name}").cast("long")
    width = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    height = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    inter = F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))
    area = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(F.lit(0.0))


#: Tiles are 512 pixels wide and 64 high for boxes below that size, and the same power
#: of it for larger ones: two to the power of these bits.
TILE_BITS = {"x": 9, "y": 6}


def _size_class(axis: str, low: Column, high: Column, times: int = 1) -> Column:
    """How often the extent of a box reaches the size of a tile; exact on whole pixels."""
    extent = (high.cast("long") - low.cast("long")) * times
    return F.floor((F.length(F.bin(extent)) - 1) / TILE_BITS[axis]).cast("int")


def _cell(axis: str, at: Column) -> Column:
    """The tile of its class in which a place lies."""
    return F.floor(at / F.pow(F.lit(2.0), TILE_BITS[axis] * (F.col(f"_class_{axis}") + 1)))


def _middle(low: str, high: str) -> Column:
    return (F.col(low).cast("long") + F.col(high).cast("long")) / 2


def _cells(boxes: DataFrame, low: str, high: str, axis: str, covered: bool) -> DataFrame:
    """Boxes once per class of tile they may meet a partner in, and there once per tile
    they cover, or once by their center. A tile is at least as long as a box of its
    class, so a box covers two at most, however large it is."""
    extent = F.col(low), F.col(high)
    sized = boxes.withColumn(f"_class_{axis}", F.explode(F.array_distinct(F.array(*[_size_class(axis, *extent, n) for n in (1, 2)]))))
    spots = F.explode(F.array_distinct(F.array(*[_cell(axis, at) for at in extent]))) if covered else _cell(axis, _middle(low, high))
    return sized.withColumn(f"_cell_{axis}", spots)


def overlapping_pairs(boxes: DataFrame, keys: Sequence[str], iou: float) -> DataFrame:
    """(page, better, worse) for boxes (``rank``, corners) that overlap by at least
    ``iou``, which is half or more.

    Such boxes differ at most by a factor of two in width and height, and each holds
    the other's center. So they meet in the tile, of the larger one's size class, that
    holds the center of the worse. A tile's boxes are gathered and compared where they
    lie: pages dealt out by their key move no box, and a page that is not is spread by
    its tiles."""
    on = [*keys, "_class_x", "_class_y", "_cell_x", "_cell_y"]
    tiles = _cells(_cells(boxes, "x0", "x1", "x", True), "y0", "y1", "y", True)
    holds = lambda a: F.col(f"_cell_{a}") == _cell(a, _middle(f"{a}0", f"{a}1"))
    box = F.struct("rank", "x0", "y0", "x1", "y1", (holds("x") & holds("y")).alias("_own"))
    gathered = tiles.groupBy(*on).agg(F.collect_list(box).alias("_boxes")).where(F.size("_boxes") > 1)
    worse = gathered.select("*", F.explode("_boxes").alias("worse")).where("worse._own")
    larger = lambda axis: F.greatest(
        *[_size_class(axis, F.col(f"{side}.{axis}0"), F.col(f"{side}.{axis}1")) for side in ("better", "worse")]
    )
    meet = lambda a: (F.col(f"better.{a}0") < F.col(f"worse.{a}1")) & (F.col(f"worse.{a}0") < F.col(f"better.{a}1"))
    return (
        worse.select(*on, "worse", F.explode("_boxes").alias("better"))
        .where(meet("x") & meet("y"))
        .where((F.col("better.rank") < F.col("worse.rank")) & (_overlap("better", "worse") >= iou))
        .where((F.col("_class_x") == larger("x")) & (F.col("_class_y") == larger("y")))
        .select(*keys, F.col("better.rank").alias("better"), F.col("worse.rank").alias("worse"))
    )


#: Rounds of parallel decisions before long chains are followed in order.
ROUNDS = 12


def _plain(value):
    return tuple(_plain(v) for v in value.values()) if isinstance(value, dict) else value


def _in_order(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(page, worse) of the boxes that go, by one pass over the pairs of a page in order
    of the worse box: when its turn comes, all better ones are decided. Holds the boxes
    of one page that are gone."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, gone = None, set()
        for batch in batches:
            pages = zip(*(batch.column(k).to_pylist() for k in keys))
            out = []
            for this, better, worse in zip(pages, batch.column("better").to_pylist(), batch.column("worse").to_pylist()):
                if this != page:
                    page, gone = this, set()
                better, worse = _plain(better), _plain(worse)
                goes = worse not in gone and better not in gone
                if goes:
                    gone.add(worse)
                out.append(goes)
            yield batch.select([*keys, "worse"]).filter(pa.array(out, pa.bool_()))

    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, "worse", "better")
    fields = {f.name: f for f in pairs.schema.fields}
    schema = T.StructType([fields[k] for k in [*keys, "worse"]])
    return ordered.mapInArrow(decide, schema)


def suppressed(pairs: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """(page, rank) of the boxes that go: those that overlap a better box that stays.

    Decided in rounds, as in a search for independent sets: a box that no undecided box
    betters stays, those it betters go, and pairs with a decided box are done. Rounds
    are joins on (page, box), so a page with very many boxes is spread like any other.
    A group of detections needs one round or two. What ``rounds`` leave are chains of
    boxes each barely overlapping the next, which no order but theirs decides; their
    pairs alone are followed one by one."""
    keys = list(keys)
    left, gone = reliable(pairs), []
    for _ in range(rounds):
        if left.isEmpty():
            break
        bettered = left.select(*keys, F.col("worse").alias("better")).distinct().withColumn("_bettered", F.lit(True))
        marked = reliable(left.join(bettered, [*keys, "better"], "left"))
        out = reliable(marked.where("_bettered IS NULL").select(*keys, F.col("worse").alias("rank")).distinct())
        gone.append(out)
        open_ = marked.where("_bettered").drop("_bettered")
        for side in ("better", "worse"):
            open_ = open_.join(out.withColumnRenamed("rank", side), [*keys, side], "left_anti")
        left = reliable(open_.select(*keys, "better", "worse"))
    else:
        if not left.isEmpty():
            gone.append(_in_order(left, keys).withColumnRenamed("worse", "rank"))
    none = pairs.limit(0).select(*keys, F.col("worse").alias("rank"))
    return reduce(DataFrame.unionByName, gone, none)


def dedupe_overlaps(words: DataFrame, keys: Sequence[str] = ("doc_id",), iou: float = MIN_OVERLAP) -> DataFrame:
    """Drop second detections of the same glyphs: boxes that overlap a kept, more
    confident box (ties: the earlier word).

    Words with the very same box are first reduced to their best, with partial
    aggregation, so copies of one word never meet each other. That is worked out for the
    pairing and again for the result: written in between, its rows would have to be
    dealt out anew. Boxes without area overlap nothing and stay."""
    if iou < 0.5:
        raise ValueError("the cell join needs an overlap of at least one half")
    keys = list(keys)
    box = ["x0", "y0", "x1", "y1"]
    rest = [c for c in words.columns if c not in (*keys, *box)]
    has_area = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    rank = F.struct((F.lit(0.0) - F.col("conf")).alias("less"), F.col("word_no").alias("no"))
    best = (
        words.groupBy(*keys, *box, F.when(~has_area, F.col("word_no")).alias("_flat"))
        .agg(F.min(F.struct(rank.alias("rank"), *rest)).alias("_best"))
        .select(*keys, *box, "_best.*")
    )
    gone = suppressed(overlapping_pairs(best.filter(has_area).select(*keys, "rank", *box), keys, iou), keys)
    return best.join(gone, [*keys, "rank"], "left_anti").select(*words.columns)

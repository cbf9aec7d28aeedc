"""Nested reader responses as word rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.common import blank

ANNOTATION = (
    "struct<text: string, pages: array<struct<blocks: array<struct<paragraphs: array<struct<words: array<struct<"
    "symbols: array<struct<text: string>>, confidence: double, "
    "bounding_box: struct<vertices: array<struct<x: int, y: int>>>>>>>>>>>>"
)


def _word(w: Column) -> Column:
    corners = w["bounding_box"]["vertices"]
    # a response leaves out numbers that are 0
    place = lambda axis: F.transform(corners, lambda v: F.coalesce(v[axis], F.lit(0)))
    xs, ys = place("x"), place("y")
    bound = lambda of, all_: F.coalesce(of(all_), F.lit(0))
    return F.struct(
        F.coalesce(F.array_join(F.transform(w["symbols"], lambda s: F.coalesce(s["text"], F.lit(""))), ""), F.lit("")).alias("text"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(w["confidence"], F.lit(0.0)))).alias("conf"),
        bound(F.array_min, xs).alias("x0"), bound(F.array_min, ys).alias("y0"),
        bound(F.array_max, xs).alias("x1"), bound(F.array_max, ys).alias("y1"),
    )


def _members(of: Column, member: str) -> Column:
    """The members of all elements; an element without its list has none."""
    lists = F.transform(of, lambda e: e[member])
    return F.flatten(F.filter(lists, lambda found: found.isNotNull()))


def flatten_annotations(df: DataFrame, keys: Sequence[str] = ("doc_id",), annotation: str = "annotation") -> DataFrame:
    """Words of each response in document order (``word_no``), empty words
    dropped, boxes from the corner points, confidence kept within 0..1. A
    response without text gives no rows. A list that is left out is empty, a
    number that is left out is 0. All within the row: no shuffle."""
    pages = F.when(~blank(f"{annotation}.text"), F.col(f"{annotation}.pages"))
    raw = _members(_members(_members(pages, "blocks"), "paragraphs"), "words")
    words = F.filter(F.transform(raw, _word), lambda w: w["text"] != "")
    return df.select(*keys, F.posexplode(words).alias("word_no", "_w")).select(*keys, "word_no", "_w.*")

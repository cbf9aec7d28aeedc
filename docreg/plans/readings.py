"""Choosing among several readings of one page: rows (doc_id, attempt), tried in
order of ``attempt``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.functions.mrz import candidate_lines
from docreg.operators.labels import ORDERED_ANCHORS, find_label_lines, label_table, orientation_ok
from docreg.operators.words import rotated_pages

_KEYS = ["doc_id", "attempt"]


def zone_readings(pages: DataFrame) -> DataFrame:
    """(doc_id, attempt, full_text): the first attempt that holds two lines of a
    zone; documents without such an attempt have NULL in both. One partially
    combined aggregate."""
    holds = F.coalesce(F.size(candidate_lines("full_text")) >= 2, F.lit(False))
    first = F.min(F.when(holds, F.struct("attempt", "full_text")))
    return pages.groupBy("doc_id").agg(first.alias("_first")).select("doc_id", "_first.attempt", "_first.full_text")


def page_readings(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, attempt): the first attempt if its words do not lie on their side;
    else the first later one whose words neither lie on their side nor stand out of
    order; else the first attempt after all. ``pages`` lists every attempt."""
    anchors = label_table(words.sparkSession, [(a, a, None) for a in ORDERED_ANCHORS])
    sideways = rotated_pages(words, _KEYS, pages).select(*_KEYS, "rotated")
    ordered = orientation_ok(find_label_lines(words, anchors, _KEYS), _KEYS, pages=pages).select(*_KEYS, "upright")
    judged = sideways.join(ordered, _KEYS)
    good = F.min(F.when(~F.col("rotated") & F.col("upright"), F.col("attempt")))
    found = judged.groupBy("doc_id").agg(F.min(F.struct("attempt", "rotated")).alias("_own"), good.alias("_good"))
    chosen = F.when(~F.col("_own.rotated"), F.col("_own.attempt")).otherwise(F.coalesce("_good", "_own.attempt"))
    return found.select("doc_id", chosen.alias("attempt"))

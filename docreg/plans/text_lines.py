"""Text lines with box and mean confidence: the smallest useful job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from docreg.operators.lines import boxed_lines
from docreg.operators.words import filter_confident


def text_lines(words: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    return boxed_lines(filter_confident(words), keys)

"""Audit log text as events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docreg.common import computed
from docreg.operators.audit import ESCAPES

#: How an event begins; what begins otherwise goes on with the event before it.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} "
_LINE = r"(?s)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (.*)$"
_PAIR = r'([A-Za-z0-9_.]+)=("[^"\\]*+(?:\\.[^"\\]*+)*+"|\S*)'


def _value(raw: Column, escaped: Column) -> Column:
    quoted = F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"')) & (F.length(raw) >= 2)
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    old = F.replace(inner, F.lit('\\"'), F.lit('"'))
    # a doubled backslash is set aside while the other escapes are undone
    aside = F.replace(inner, F.lit("\\\\"), F.lit("\x00"))
    undone = F.replace(F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"'))
    new = F.replace(undone, F.lit("\x00"), F.lit("\\"))
    return F.when(quoted, F.when(escaped, new).otherwise(old)).otherwise(raw)


def parse_audit(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(ts, event, user, attrs, malformed, line) of each line, behind the columns to ``keep``. Lines in the old
    form, which escapes only quotes, and marked lines are both read; a line
    without a time stamp is kept as ``malformed``, with its text in ``line``, so
    the second half of a broken line is not lost."""
    split = computed(lines.select(*keep, value), F.regexp_extract(value, _LINE, 1).alias("_ts"), F.regexp_extract(value, _LINE, 2).alias("_rest"))
    found = computed(
        split,
        F.try_to_timestamp(F.nullif(F.col("_ts"), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.regexp_extract_all("_rest", F.lit(_PAIR), F.lit(1)).alias("_k"),
        F.regexp_extract_all("_rest", F.lit(_PAIR), F.lit(2)).alias("_v"),
        F.endswith("_rest", F.lit(" " + ESCAPES)).alias("_escaped"),
    )
    marker = ESCAPES.split("=")[0]
    pairs = F.transform(
        F.arrays_zip("_k", "_v"), lambda p: F.struct(p["_k"].alias("key"), _value(p["_v"], F.col("_escaped")).alias("value"))
    )
    first = lambda p, i: (F.array_position(F.col("_k"), p["key"]) == i + 1) & ~(F.col("_escaped") & (p["key"] == marker))
    return computed(found, F.map_from_entries(F.filter(pairs, first)).alias("_attrs")).select(
        *keep,
        "ts",
        F.try_element_at("_attrs", F.lit("event")).alias("event"),
        F.try_element_at("_attrs", F.lit("user")).alias("user"),
        F.map_filter("_attrs", lambda k, v: ~k.isin("event", "user")).alias("attrs"),
        F.col("ts").isNull().alias("malformed"),
        F.when(F.col("ts").isNull(), F.col(value)).alias("line"),
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of log files in an order that can be told.
    A file that is read in several splits has a block for each, named by its first
    byte; ``at`` rises within a block."""
    lines = spark.read.text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def whole_events(lines: DataFrame) -> DataFrame:
    """(file, value): the lines of each event in one, joined by line breaks. Old lines
    do not escape a break inside a value, so an event may go on over several lines,
    and its first line may lie in an earlier split of the file.

    Events are numbered by their first line. Lines find it inside their block; those
    ahead of a block's first event take the last of the blocks before, of which one
    row each is compared. Lines before any event are kept, each for itself."""
    begins = F.col("value").rlike("^" + STAMP)
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("_first", F.last(F.when(begins, F.col("at")), ignorenulls=True).over(inside))
    blocks = lines.groupBy("file", "block").agg(F.max(F.when(begins, F.col("at"))).alias("_end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    found = own.join(carried, ["file", "block"]).withColumn("_event", F.coalesce("_first", "_carried", "at"))
    parts = found.groupBy("file", "_event").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("_parts"))
    return parts.select("file", F.array_join(F.transform("_parts", lambda p: p["value"]), "\n").alias("value"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The events of log files, broken ones whole again."""
    return parse_audit(whole_events(numbered_lines(spark, path)))


def attr(key: str) -> Column:
    return F.try_element_at("attrs", F.lit(key)).alias(key)

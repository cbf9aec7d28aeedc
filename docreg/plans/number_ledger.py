"""Serial numbers that are never issued twice.

A counter has a ledger: one committed version per batch with the range of numbers
reserved for it. A batch reserves behind the last range, and behind any number that
stands in the records already, also one typed by hand. The reservation is committed
before numbers are handed out. A batch that is run again finds its own reservation and
gives every row the number it got before, as long as ``order`` tells rows apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docreg.common import blank, reliable, text_or_blank, trimmed
from docreg.operators.registry import number_of, number_text
from docreg.sources.commits import commit, last_version

LEDGER = "batch string, first long, last long"
_ROW_BITS = 33  # of an increasing id, the row within its partition


def placed_rows(rows: DataFrame, order: Column | str) -> DataFrame:
    """The rows with ``_place`` from 0 by ``order``. One range sort: rows are counted
    where they lie, and only the partitions' sizes are summed, in one window of as
    many rows as there are partitions. Written, so that places stay."""
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order)
    written = reliable(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = written.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("_place", F.col("_ahead") + inside).drop("_part", "_ahead", "_id")


def ledger(spark, root: str) -> DataFrame:
    """(batch, first, last) of every committed reservation of a counter."""
    last = last_version(spark, root)
    if last is None:
        return spark.createDataFrame([], LEDGER)
    return spark.read.parquet(root).where(F.col("version") <= last).select("batch", "first", "last")


def reserve(spark, root: str, batch: str, n: int, used: int = 0) -> int:
    """The first of ``n`` numbers that are the batch's from now on. ``used`` is the
    highest number known to be taken. One row is read and one written."""
    own = ledger(spark, root).agg(
        F.max(F.when(F.col("batch") == batch, F.struct("first", "last"))).alias("own"), F.coalesce(F.max("last"), F.lit(0)).alias("top")
    ).first()
    if own.own is not None:
        if own.own.last - own.own.first + 1 != n:
            raise ValueError(f"batch {batch} reserved {own.own.last - own.own.first + 1} numbers, not {n}")
        return own.own.first
    first = max(own.top, used) + 1
    last = last_version(spark, root)
    row = spark.createDataFrame([(batch, first, first + n - 1)], LEDGER).coalesce(1)
    commit(row, root, 0 if last is None else last + 1)
    return first


def _highest(records: DataFrame, column: str, prefix: str) -> int:
    return records.agg(F.coalesce(F.max(number_of(column, prefix)), F.lit(0)).alias("used")).first().used


def issue_numbers(
    records: DataFrame, column: str, root: str, batch: str, prefix: str = "", order: str = "id", registry: DataFrame | None = None
) -> DataFrame:
    """The records, those without a number in ``column`` with the next ones of the
    counter whose ledger lies in ``root``, in order of ``order``. Numbered rows keep
    theirs. ``registry`` holds further records whose numbers are taken."""
    to_number = blank(trimmed(text_or_blank(column)))
    n = records.where(to_number).count()
    if n == 0:
        return records
    used = max(_highest(table, column, prefix) for table in (records, registry) if table is not None)
    first = reserve(records.sparkSession, root, batch, n, used)
    placed = placed_rows(records.where(to_number), order)
    fresh = placed.withColumn(column, number_text(F.col("_place") + first, prefix)).select(*records.columns)
    return records.where(~to_number).unionByName(fresh)

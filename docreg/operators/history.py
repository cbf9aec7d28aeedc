"""What was changed on a record: the history that correction lines tell.

A correction (ts, record_id, field, old, new, user) gives its field a value from its
time on. Corrections of one second follow each other by ``seq``, the order of the
lines, if the table has it, else by their values.

Windows are over one field of one record, so a record with very many corrections is
spread by its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(corrections: DataFrame) -> DataFrame:
    """Corrections with ``_at``, their place among those of their field."""
    seq = F.col("seq") if "seq" in corrections.columns else F.lit(0)
    order = F.row_number().over(Window.partitionBy("record_id", "field").orderBy("ts", seq, "old", "new", "user"))
    return corrections.withColumn("_at", order)


def change_history(corrections: DataFrame) -> DataFrame:
    """One row per correction with the time its value held: (record_id, field, step,
    valid_from, valid_to, value, old, user, intact). ``valid_to`` is NULL while the
    value holds; ``intact`` tells whether the old value is the one known before, which
    the first correction of a field cannot tell. A break means that a line is missing
    or the record was changed elsewhere."""
    rows = _ordered(corrections)
    within = Window.partitionBy("record_id", "field").orderBy("_at")
    blank = lambda c: F.coalesce(c, F.lit(""))
    before = F.lag("new").over(within)
    return rows.select(
        "record_id", "field", F.col("_at").cast("long").alias("step"), F.col("ts").alias("valid_from"), F.lead("ts").over(within).alias("valid_to"),
        blank(F.col("new")).alias("value"), blank(F.col("old")).alias("old"), "user",
        ((F.col("_at") == 1) | (blank(before) == blank(F.col("old")))).alias("intact"),
    )


def values_at(history: DataFrame, at: Column) -> DataFrame:
    """(record_id, field, value, user, valid_from): what corrections made of each field
    by a time. Of several steps of one moment the last counts. Aggregated, so only one
    row of a field moves from each task."""
    known = history.where(F.col("valid_from") <= at)
    last = known.groupBy("record_id", "field").agg(F.max(F.struct("step", "value", "user", "valid_from")).alias("_last"))
    return last.select("record_id", "field", "_last.value", "_last.user", "_last.valid_from")


def state_at(records: DataFrame, history: DataFrame, at: Column) -> DataFrame:
    """Records (id, fields) as corrections had left them at a time: fields changed later
    hold the old value of the first later correction."""
    later = history.where(F.col("valid_from") > at).groupBy(F.col("record_id").cast("long").alias("id"), "field").agg(
        F.min(F.struct("step", "old")).alias("_first")
    )
    undone = later.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "_first.old"))).alias("_old"))
    both = records.join(undone, "id", "left")
    fields = F.when(F.col("_old").isNull(), F.col("fields")).otherwise(
        F.map_concat(F.map_filter("fields", lambda k, v: ~F.array_contains(F.map_keys("_old"), k)), F.col("_old"))
    )
    return both.select("id", fields.alias("fields"))


def changes_per_record(history: DataFrame) -> DataFrame:
    """What was changed on each record: number of corrections, fields and users, first
    and last time, breaks in the chains, and the fields by name."""
    per_field = history.groupBy("record_id", "field").agg(
        F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"), F.count_if(~F.col("intact")).alias("breaks"),
        F.min(F.struct("step", "old"))["old"].alias("was"), F.max(F.struct("step", "value"))["value"].alias("now"),
    )
    users = history.select("record_id", "user").distinct().groupBy("record_id").agg(F.count(F.lit(1)).alias("n_users"))
    changed = F.array_sort(F.collect_list(F.when(F.col("was") != F.col("now"), F.col("field"))))
    found = per_field.groupBy("record_id").agg(
        F.sum("n").alias("n_corrections"), F.count(F.lit(1)).alias("n_fields"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.sum("breaks").alias("n_breaks"), F.array_join(changed, ",").alias("changed_fields"),
    )
    return found.join(users, "record_id")

"""Audit events: writing them as lines, and the questions the log answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docreg.common import blank, col

#: Marks a line whose quoted values also escape backslash and line breaks.
ESCAPES = "esc=1"
UNSAVED = "unsaved"
DOCUMENTS = {"print": "booklet", "receipt": "receipt", "form": "form"}


def quote(c: Column | str) -> Column:
    """A value as it stands on the line: blank as "", white space or a quote in
    quotes. Inside quotes a backslash and a line break are escaped, so a line
    stays one line; ``needs_escape`` tells which lines need the mark."""
    value = F.coalesce(col(c), F.lit(""))
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return (
        F.when(value == "", '""')
        .when(value.rlike(r'[\s"]'), F.concat(F.lit('"'), F.replace(escaped, F.lit('"'), F.lit('\\"')), F.lit('"')))
        .otherwise(value)
    )


def needs_escape(c: Column | str) -> Column:
    quoted, special = col(c).rlike(r'[\s"]'), col(c).rlike(r"[\\\n\r]")
    return F.coalesce(quoted & special, F.lit(False))


def format_audit(events: DataFrame, attrs: Sequence[str], ts: str = "ts", also: Sequence[str] = ()) -> DataFrame:
    """Events as lines ``yyyy-MM-dd HH:mm:ss key=value ...`` in column ``value``,
    behind the columns of ``also``."""
    pairs = [F.concat(F.lit(f"{a}="), quote(a)) for a in attrs]
    marked = F.exists(F.array(*[needs_escape(a) for a in attrs]), lambda m: m)
    line = F.concat_ws(
        " ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), *pairs, F.when(marked, F.lit(ESCAPES))
    )
    return events.select(*also, line.alias("value"))


def save_lines(saves: DataFrame, diffs: DataFrame) -> DataFrame:
    """Lines of a batch of saves: one per record saved and one per field changed.

    ``saves`` has ts, user, record_id and mode; ``diffs`` id, field, old, new."""
    changed = diffs.groupBy(F.col("id").alias("record_id")).agg(F.count(F.lit(1)).alias("changed_field_count"))
    saved = saves.join(changed, "record_id", "left").select(
        "ts", F.lit("record_saved").alias("event"), "user", F.col("record_id").cast("string").alias("record_id"),
        "mode", F.coalesce("changed_field_count", F.lit(0)).cast("string").alias("changed_field_count"),
    )
    corrected = saves.join(diffs.withColumnRenamed("id", "record_id"), "record_id").select(
        "ts", F.lit("field_corrected").alias("event"), "user", F.col("record_id").cast("string").alias("record_id"),
        "field", "old", "new",
    )
    return format_audit(saved, ["event", "user", "record_id", "mode", "changed_field_count"]).unionByName(
        format_audit(corrected, ["event", "user", "record_id", "field", "old", "new"])
    )


def print_reconciliation(events: DataFrame) -> DataFrame:
    """Previewed, dispatched and failed prints per record and kind of document."""
    kind = F.regexp_extract("event", r"^(print|receipt|form)_(rendered|dispatched|dispatch_failed)$", 1)
    step = F.regexp_extract("event", r"^(print|receipt|form)_(rendered|dispatched|dispatch_failed)$", 2)
    names = F.create_map(*[F.lit(x) for pair in DOCUMENTS.items() for x in pair])
    record = F.coalesce(F.col("record_id"), F.lit(UNSAVED))
    return (
        events.select(record.alias("record_id"), kind.alias("_kind"), step.alias("_step"))
        .filter(F.col("_kind") != "")
        .groupBy("record_id", F.element_at(names, F.col("_kind")).alias("document"))
        .agg(
            F.count_if(F.col("_step") == "rendered").alias("previewed"),
            F.count_if(F.col("_step") == "dispatched").alias("dispatched"),
            F.count_if(F.col("_step") == "dispatch_failed").alias("failed"),
        )
    )


def record_history(events: DataFrame) -> DataFrame:
    """Who worked on a record, when it was created and last saved, how often.
    Users are first made distinct, so only names per record are gathered."""
    saved = events.filter((F.col("event") == "record_saved") & ~blank("record_id"))
    per_user = saved.groupBy("record_id", "user").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    )
    return per_user.groupBy("record_id").agg(
        F.min("first").alias("created"), F.max("last").alias("last_saved"), F.sum("n").alias("saves"),
        F.count(F.lit(1)).alias("n_users"), F.min_by("user", F.struct("first", "user")).alias("created_by"),
    )


def corrections(events: DataFrame) -> DataFrame:
    """Corrections per field and user, with their first and last time."""
    return events.filter(F.col("event") == "field_corrected").groupBy("field", "user").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )

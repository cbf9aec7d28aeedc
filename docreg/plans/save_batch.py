"""Saving a batch of new records and record changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.operators.audit import save_lines
from docreg.operators.registry import diff_records, get_records, new_records, one_per_id, upsert_records, validate_records


class Saved(NamedTuple):
    records: DataFrame
    diffs: DataFrame
    rejects: DataFrame
    lines: DataFrame


def save_batch(records: DataFrame, changes: DataFrame, user: str = "", at: str | None = None) -> Saved:
    """Validate, diff and apply a batch (id, fields; optional version and seq).

    A change without id is a new record: it is numbered on from the highest id in
    order of ``seq``, and created ``at`` (text or time stamp as in the records). Its
    issued number is the one typed; none is made up. Of several changes to one id
    the last version counts. Rejects carry their reason: a missing field, an id no
    record has, or repeated changes without a version. ``lines`` are the audit
    lines of what was saved, written in the same step."""
    one, repeated = one_per_id(changes)
    kept = ["id", "fields", *[c for c in ("seq",) if c in changes.columns]]
    valid, invalid = validate_records(one.select(*kept))
    update = reliable(valid.where(F.col("id").isNotNull()).select("id", "fields"))
    order = F.col("seq") if "seq" in changes.columns else F.xxhash64(F.to_json("fields"))
    created = F.lit(at).cast(records.schema["created_at"].dataType)
    new = valid.where(F.col("id").isNull()).select(order.alias("seq"), created.alias("created_at"), "fields")
    fresh = reliable(new_records(records, new))
    changed, unknown = upsert_records(records, update)
    diffs = diff_records(records, update)
    reason = lambda df, why: df.select("id", "fields", F.lit(why).alias("reason"))
    rejects = invalid.select("id", "fields", "reason").unionByName(reason(unknown, "unknown id")).unionByName(reason(repeated, "repeated id"))
    stamp = lambda df, mode: df.select(F.to_timestamp(F.lit(at)).alias("ts"), F.lit(user).alias("user"), F.col("id").alias("record_id"), F.lit(mode).alias("mode"))
    applied = get_records(update, records)
    lines = save_lines(stamp(applied, "update").unionByName(stamp(fresh, "insert")), diffs)
    return Saved(changed.unionByName(fresh), diffs, rejects, lines)

"""What the audit log says about prints, records and corrections."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.operators.audit import corrections, print_reconciliation, record_history
from docreg.operators.history import change_history, changes_per_record
from docreg.sources.audit_log import attr, parse_audit


class AuditReport(NamedTuple):
    prints: DataFrame
    records: DataFrame
    corrections: DataFrame
    rejects: DataFrame
    changes: DataFrame


def audit_report(lines: DataFrame, several: bool = False) -> AuditReport:
    """Log lines (column ``value``) → the reports on prints, records and corrections,
    the lines that are no events, and what was changed on each record.

    Each report reads the lines anew; with ``several`` they are parsed and written once
    when this is called, for a caller that goes on with more than one."""
    parsed = parse_audit(lines).select("ts", "event", "user", *[attr(c) for c in ("record_id", "field", "old", "new")], "malformed", "line")
    if several:
        parsed = reliable(parsed)
    events = parsed.filter("NOT malformed").drop("malformed", "line")
    changed = events.where((F.col("event") == "field_corrected") & F.col("record_id").isNotNull())
    return AuditReport(
        print_reconciliation(events), record_history(events), corrections(events), parsed.filter("malformed").select("line"),
        changes_per_record(change_history(changed)),
    )

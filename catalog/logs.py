"""Audit lines, intake, word dumps and reader jobs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import inputs as i
from docreg.common import drop_folder, reliable, work_path
from docreg.operators import audit as a, history as h
from docreg.operators.registry import diff_records
from docreg.plans.audit_report import audit_report
from docreg.sources import audit_log, intake, word_dumps
from docreg.sources.commits import children, move
from docreg.streaming import preview_stream as p
from docreg.streaming.audit_stream import stream_audit
from docreg.streaming.log_ingest import ingest_logs, ingested_events

_ATTRS = ["event", "user", "record_id", "note"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return a.format_audit(i.audit(spark, sf), _ATTRS)


def _broken(spark: SparkSession, sf: str) -> DataFrame:
    """The lines, some of them broken in two: the second half is no event."""
    lines = _lines(spark, sf)
    torn = F.pmod(F.length("value"), F.lit(10)) == 3
    return lines.unionByName(lines.where(torn).select(F.concat(F.lit("rest of "), F.col("value")).alias("value")))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _parsed(events: DataFrame) -> DataFrame:
    return events.select(
        _stamp("ts").alias("ts"), "event", "user", audit_log.attr("record_id"), audit_log.attr("note"), "malformed", F.coalesce("line", F.lit("")).alias("line")
    )


def _parse(spark, sf):
    return _parsed(audit_log.parse_audit(_broken(spark, sf)))


def _save_lines(spark, sf):
    """Every change as a save, with its differences to the order's record."""
    changes = i.record_changes(spark, sf)
    saves = changes.select(
        F.lit("2026-01-01 08:00:00").cast("timestamp").alias("ts"), F.lit("u1").alias("user"),
        F.col("id").alias("record_id"), F.lit("update").alias("mode"),
    )
    return a.save_lines(saves, diff_records(i.records(spark, sf), changes))


def _prints(spark, sf):
    return audit_report(_lines(spark, sf)).prints


def _history(spark, sf):
    h = audit_report(_lines(spark, sf)).records
    return h.select("record_id", _stamp("created").alias("created"), _stamp("last_saved").alias("last_saved"), "saves", "n_users", "created_by")


def _correction_lines(spark, sf):
    """Events as corrections of a field named after their type."""
    events = i.table(spark, sf, "events").select(
        "ts", F.lit("field_corrected").alias("event"), F.concat(F.lit("u"), "user_id").alias("user"),
        F.col("event_type").alias("field"), F.lit("").alias("old"), F.col("props").alias("new"),
    )
    return a.format_audit(events, ["event", "user", "field", "old", "new"])


def _corrections(spark, sf):
    c = audit_report(_correction_lines(spark, sf)).corrections
    return c.select("field", "user", "n", _stamp("first").alias("first"), _stamp("last").alias("last"))


def _report(spark, sf):
    """All reports of one log that holds prints, saves, corrections and broken lines."""
    report = audit_report(_broken(spark, sf).unionByName(_correction_lines(spark, sf)), several=True)
    text = lambda c, n: F.coalesce(c.cast("string"), F.lit("")).alias(n)
    row = lambda df, kind, key, *cols: df.select(F.lit(kind).alias("report"), text(F.col(key), "key"), *[text(c, n) for c, n in zip(cols, "abcd")])
    col = F.col
    return (
        row(report.prints, "prints", "record_id", col("document"), col("previewed"), col("dispatched"), col("failed"))
        .unionByName(row(report.records, "records", "record_id", _stamp("created"), _stamp("last_saved"), col("saves"), col("created_by")))
        .unionByName(row(report.corrections, "corrections", "field", col("user"), col("n"), _stamp("first"), _stamp("last")))
        .unionByName(row(report.rejects, "rejects", "line", F.lit(""), F.lit(""), F.lit(""), F.lit("")))
    )


def _streamed(spark, sf):
    root = work_path(spark, "audit")
    _broken(spark, sf).repartition(5).write.text(f"{root}/in")
    stream_audit(spark, f"{root}/in", f"{root}/events", f"{root}/state", files_per_batch=2).awaitTermination()
    return _parsed(spark.read.parquet(f"{root}/events"))


def _changes(spark, sf):
    """Corrections of 40 records, read from log lines: the old value of most is the new
    one before."""
    events = i.table(spark, sf, "events").withColumn("record_id", (F.col("event_id") % 40).cast("string"))
    before = F.lag(F.concat(F.lit("v"), "event_id")).over(Window.partitionBy("record_id", "event_type").orderBy(F.date_trunc("second", "ts"), "event_id"))
    corrections = events.select(
        "event_id", "ts", F.lit("field_corrected").alias("event"), F.concat(F.lit("u"), "user_id").alias("user"), "record_id", F.col("event_type").alias("field"),
        F.when(F.col("event_id") % 13 == 0, "lost").otherwise(F.coalesce(before, F.lit(""))).alias("old"), F.concat(F.lit("v"), "event_id").alias("new"),
    )
    lines = a.format_audit(corrections, ["event", "user", "record_id", "field", "old", "new"], also=["event_id"])
    parsed = audit_log.parse_audit(lines, keep=["event_id"])
    return parsed.select("ts", "user", F.col("event_id").alias("seq"), *[audit_log.attr(c) for c in ("record_id", "field", "old", "new")])


def _change_history(spark, sf):
    found = h.change_history(_changes(spark, sf))
    return found.withColumns({c: _stamp(c) for c in ("valid_from", "valid_to")})


def _changes_per_record(spark, sf):
    found = h.changes_per_record(h.change_history(_changes(spark, sf)))
    return found.withColumns({c: _stamp(c) for c in ("first", "last")})


def _values_at(spark, sf):
    """What corrections had made of the records in the middle of the log's time."""
    events = i.table(spark, sf, "events")
    middle = events.agg(F.date_trunc("day", F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("at")).first().at
    found = h.values_at(h.change_history(_changes(spark, sf)), F.lit(middle))
    return found.withColumn("valid_from", _stamp("valid_from"))


def _open_previews(spark, sf):
    """Events in order of their days, in four parts, some events twice, streamed."""
    root = work_path(spark, "previews")
    events = reliable(i.audit(spark, sf).select("event_id", F.date_trunc("second", "ts").alias("ts"), "event", "user", "record_id"))
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    step = (ends.high - ends.low) / 4
    for k in range(4):
        part = events.where((F.col("ts") >= ends.low + k * step) & ((F.col("ts") < ends.low + (k + 1) * step) if k < 3 else F.lit(True)))
        part.unionByName(part.where("event_id % 11 = 0")).write.mode("append").parquet(f"{root}/in")
        p.stream_previews(spark, f"{root}/in", f"{root}/out", f"{root}/state", "INTERVAL 6 HOURS", "2 days").awaitTermination()
    found = p.first_answers(spark.read.parquet(f"{root}/out"))
    settled = found.where(F.col("previewed") < F.lit(ends.high - timedelta(days=3)))
    return settled.withColumns({c: _stamp(c) for c in ("previewed", "answered")})


def _put_logs(spark, lines: DataFrame, folder: str, name: str) -> None:
    """One file per host below the folder, in place of what is there."""
    staged = work_path(spark, "staged")
    lines.repartition(1, "host").sortWithinPartitions("host", "event_id", "copy").select("host", "value").write.partitionBy("host").text(staged)
    for host in children(spark, staged):
        for part in children(spark, host):
            if "/part-" in part:
                target = f"{folder}/{host.rsplit('/', 1)[1]}/{name}"
                drop_folder(spark, target)
                move(spark, part, target)


def _rotated(spark, sf):
    """The lines as logs of three hosts, some of them twice, taken in while the logs
    grow, rotate, are taken again without news and begin anew."""
    root = work_path(spark, "rotated")
    events = i.audit(spark, sf)
    top = events.agg(F.max("event_id").alias("top")).first().top
    lines = a.format_audit(events, _ATTRS, also=["event_id"]).withColumn("host", F.col("event_id") % 3).withColumn("copy", F.lit(0))
    lines = lines.unionByName(lines.where("event_id % 7 = 0").withColumn("copy", F.lit(1)))
    lines = reliable(lines.withColumn("quarter", F.floor(F.col("event_id") * 4 / (top + 1))).select("host", "event_id", "copy", "quarter", "value"))
    part = lambda low, high: lines.where(F.col("quarter").between(low, high)).drop("quarter")
    take = lambda: ingest_logs(spark, f"{root}/logs", root)
    _put_logs(spark, part(0, 0), f"{root}/logs", "audit.log")
    take()
    _put_logs(spark, part(0, 1), f"{root}/logs", "audit.log")
    take()
    for host in children(spark, f"{root}/logs"):
        move(spark, f"{host}/audit.log", f"{host}/audit.log.1")
    _put_logs(spark, part(2, 2), f"{root}/logs", "audit.log")
    take()
    for host in children(spark, f"{root}/logs"):
        move(spark, f"{host}/audit.log.1", f"{host}/audit.log.2")
        move(spark, f"{host}/audit.log", f"{host}/audit.log.1")
    _put_logs(spark, part(3, 3), f"{root}/logs", "audit.log")
    take()
    take()
    return _parsed(ingested_events(spark, root))


def _broken_notes(spark, sf):
    """Lines in the old form whose notes hold line breaks, written and read back."""
    path = work_path(spark, "old_lines")
    lines = _lines(spark, sf)
    lines.select(F.replace("value", F.lit("has space"), F.lit("has\n\nspace")).alias("value")).repartition(4).write.text(path)
    return _parsed(audit_log.read_audit(spark, path))


def _intake(spark, sf):
    return intake.intake_status(i.intake(spark, sf))


def _dumps(spark, sf):
    """The words of every document as one dump file, by source, and read back."""
    path = work_path(spark, "dumps")
    words = i.words(spark, sf, "source").select(
        F.col("source").alias("run"), F.col("doc_id").alias("region"),
        "word_no", "text", (F.col("conf") / 8).alias("conf"), "x0", "y0", "x1", "y1",
    )
    word_dumps.write_word_dumps(words, path)
    return word_dumps.read_word_dumps(spark, path)


_TS = "strftime(ts,'%Y-%m-%d %H:%M:%S')"
_EVENTS = f"""WITH {i.AUDIT_LINES}
SELECT {_TS} AS ts, event, usr AS user, record_id, note, FALSE AS malformed, '' AS line FROM audit
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, TRUE, 'rest of '||value FROM audit_lines WHERE length(value)%10=3"""
_PRINTS = """SELECT record_id, CASE split_part(event,'_',1) WHEN 'print' THEN 'booklet' ELSE split_part(event,'_',1) END AS document,
  count(*) FILTER (event LIKE '%_rendered') AS previewed, count(*) FILTER (event LIKE '%_dispatched') AS dispatched, count(*) FILTER (event LIKE '%_failed') AS failed
FROM audit WHERE event NOT LIKE 'record%' GROUP BY 1, 2"""
_QUOTED = "CASE WHEN {c}='' THEN '\"\"' WHEN {c} LIKE '% %' OR {c} LIKE '%\"%' THEN '\"'||replace({c},'\"','\\\"')||'\"' ELSE {c} END"

_CHANGES = f"""corrections AS (SELECT *, CASE WHEN event_id%13=0 THEN 'lost' ELSE coalesce(before,'') END AS old FROM (
  SELECT event_id, date_trunc('second', ts) AS ts, 'u'||user_id AS usr, CAST(event_id%40 AS VARCHAR) AS record_id, event_type AS field, 'v'||event_id AS new,
    lag('v'||event_id) OVER w AS before, row_number() OVER w AS step, lead(date_trunc('second', ts)) OVER w AS valid_to
  FROM events WINDOW w AS (PARTITION BY event_id%40, event_type ORDER BY date_trunc('second', ts), event_id)))"""

QUERIES = {
    "a11_change_history": (_change_history, f"""WITH {_CHANGES} SELECT record_id, field, step, {_TS} AS valid_from, strftime(valid_to,'%Y-%m-%d %H:%M:%S') AS valid_to, new AS value, old, usr AS user,
  step=1 OR old=before AS intact FROM corrections"""),
    "a11_changes_per_record": (_changes_per_record, f"""WITH {_CHANGES}, per_field AS (SELECT record_id, field, arg_min(old, step) AS was, arg_max(new, step) AS now FROM corrections GROUP BY 1, 2),
names AS (SELECT record_id, count(*) AS n_fields, string_agg(field, ',' ORDER BY field) FILTER (was<>now) AS changed_fields FROM per_field GROUP BY 1)
SELECT record_id, count(*) AS n_corrections, any_value(n_fields) AS n_fields, min({_TS}) AS first, max({_TS}) AS last, count(*) FILTER (step>1 AND old<>before) AS n_breaks,
  coalesce(any_value(changed_fields),'') AS changed_fields, count(DISTINCT usr) AS n_users FROM corrections JOIN names USING (record_id) GROUP BY record_id"""),
    "a11_values_at": (_values_at, f"""WITH {_CHANGES} SELECT record_id, field, arg_max(new, step) AS value, arg_max(usr, step) AS user, arg_max({_TS}, step) AS valid_from FROM corrections
WHERE ts <= (SELECT date_trunc('day', min(ts)+(max(ts)-min(ts))/2) FROM events) GROUP BY record_id, field"""),
    "a10_open_previews": (_open_previews, f"""WITH {i.AUDIT}, steps AS (SELECT event_id, date_trunc('second', ts) AS ts, coalesce(record_id,'unsaved') AS record_id,
  CASE split_part(event,'_',1) WHEN 'print' THEN 'booklet' ELSE split_part(event,'_',1) END AS document, event[strpos(event,'_')+1:] AS step FROM audit WHERE event NOT LIKE 'record%'),
found AS (SELECT p.event_id AS preview_id, p.ts AS previewed, p.record_id, p.document, min({{'answered': s.ts, 'step': s.step}}) FILTER (s.ts IS NOT NULL) AS first FROM steps p
  LEFT JOIN steps s ON s.step<>'rendered' AND s.record_id=p.record_id AND s.document=p.document AND s.ts>=p.ts AND s.ts<=p.ts+INTERVAL 6 HOURS WHERE p.step='rendered' GROUP BY ALL)
SELECT preview_id, strftime(previewed,'%Y-%m-%d %H:%M:%S') AS previewed, record_id, document, first.step AS step, strftime(first.answered,'%Y-%m-%d %H:%M:%S') AS answered, first IS NULL AS open
FROM found WHERE previewed < (SELECT date_trunc('second', max(ts))-INTERVAL 3 DAYS FROM events)"""),
    "k2_format_audit": (_lines, f"WITH {i.AUDIT_LINES} SELECT value FROM audit_lines"),
    "k2_save_lines": (_save_lines, f"""WITH {i.RECORD_KV}, {i.RECORD_CHANGES}, diffs AS (SELECT c.id, coalesce(b.v,'') AS old, c.v AS new FROM record_changes c
  JOIN (SELECT DISTINCT id FROM record_kv) x USING (id) LEFT JOIN record_kv b ON b.id=c.id AND b.k=c.k WHERE coalesce(b.v,'')<>c.v)
SELECT '2026-01-01 08:00:00 event=record_saved user=u1 record_id='||c.id||' mode=update changed_field_count='||(CASE WHEN d.id IS NULL THEN 0 ELSE 1 END) AS value
  FROM record_changes c LEFT JOIN diffs d ON c.id=d.id
UNION ALL SELECT '2026-01-01 08:00:00 event=field_corrected user=u1 record_id='||id||' field=Surname old='||{_QUOTED.format(c='old')}||' new='||{_QUOTED.format(c='new')} FROM diffs"""),
    "s5_parse_audit": (_parse, _EVENTS),
    "x1_stream_audit": (_streamed, _EVENTS),
    "x1_rotated_logs": (_rotated, f"""WITH {i.AUDIT}
SELECT {_TS} AS ts, event, usr AS user, record_id, note, FALSE AS malformed, '' AS line FROM audit, range(0, CASE WHEN event_id%7=0 THEN 2 ELSE 1 END) r"""),
    "s5_broken_notes": (_broken_notes, f"""WITH {i.AUDIT}
SELECT {_TS} AS ts, event, usr AS user, record_id, replace(note,'has space','has'||chr(10)||chr(10)||'space') AS note, FALSE AS malformed, '' AS line FROM audit"""),
    "a10_print_reconciliation": (_prints, f"WITH {i.AUDIT} {_PRINTS}"),
    "a11_record_history": (_history, f"""WITH {i.AUDIT}, saved AS (SELECT record_id, usr, {_TS} AS t FROM audit WHERE event='record_saved')
SELECT record_id, min(t) AS created, max(t) AS last_saved, count(*) AS saves, count(DISTINCT usr) AS n_users, arg_min(usr, t||usr) AS created_by FROM saved GROUP BY record_id"""),
    "a11_corrections": (_corrections, f"""SELECT event_type AS field, 'u'||user_id AS user, count(*) AS n, min({_TS}) AS first, max({_TS}) AS last FROM events GROUP BY 1, 2"""),
    "p7_audit_report": (_report, f"""WITH {i.AUDIT_LINES}, prints AS ({_PRINTS}), saved AS (SELECT record_id, usr, {_TS} AS t FROM audit WHERE event='record_saved')
SELECT 'prints' AS report, record_id AS key, document AS a, CAST(previewed AS VARCHAR) AS b, CAST(dispatched AS VARCHAR) AS c, CAST(failed AS VARCHAR) AS d FROM prints
UNION ALL SELECT 'records', record_id, min(t), max(t), CAST(count(*) AS VARCHAR), arg_min(usr, t||usr) FROM saved GROUP BY record_id
UNION ALL SELECT 'corrections', event_type, 'u'||user_id, CAST(count(*) AS VARCHAR), min({_TS}), max({_TS}) FROM events GROUP BY event_type, user_id
UNION ALL SELECT 'rejects', 'rest of '||value, '', '', '', '' FROM audit_lines WHERE length(value)%10=3"""),
    "s3_intake_status": (_intake, f"""WITH {i.INTAKE}, have AS (SELECT app_id, bool_or(kind='passport') AS p, bool_or(kind='front') AS f, bool_or(kind='back') AS b FROM intake GROUP BY app_id)
SELECT app_id, concat_ws(',', CASE WHEN NOT p THEN 'passport' END, CASE WHEN NOT f THEN 'front' END, CASE WHEN NOT b THEN 'back' END) AS missing, p AND f AND b AS complete FROM have"""),
    "s1_k3_word_dumps": (_dumps, f"""WITH {i.WORDS} SELECT source AS run, CAST(doc_id AS VARCHAR) AS region,
  (row_number() OVER (PARTITION BY doc_id ORDER BY word_no)-1)::INT AS word_no, w.text, round(conf/8, 3) AS conf, x0, y0, x1, y1 FROM words w JOIN documents USING (doc_id)"""),
}

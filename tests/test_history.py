"""Change history, previews without an answer, and the substring index."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docreg.operators import history as h, registry as r, search_index as x
from docreg.plans.audit_report import audit_report
from docreg.streaming import preview_stream as p

T0 = datetime(2026, 1, 1, 8)
CORRECTION = "ts timestamp, record_id string, field string, old string, new string, user string, seq long"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def history(spark):
    rows = [
        (at(0), "1", "Surname", "", "A", "u", 0), (at(5), "1", "Surname", "A", "B", "v", 1), (at(5), "1", "Surname", "B", "A", "u", 2),
        (at(9), "1", "Surname", "X", "C", "u", 3), (at(3), "1", "Phone", None, "7", "u", 4), (at(4), "2", "Phone", "1", "", "w", 5),
    ]
    return h.change_history(spark.createDataFrame(rows, CORRECTION).repartition(3))


def test_intervals_and_breaks(history):
    got = {(c.record_id, c.field, c.step): (c.valid_from, c.valid_to, c.value, c.intact) for c in history.collect()}
    assert got["1", "Surname", 1] == (at(0), at(5), "A", True) and got["1", "Surname", 2] == (at(5), at(5), "B", True)
    assert got["1", "Surname", 3] == (at(5), at(9), "A", True) and got["1", "Surname", 4] == (at(9), None, "C", False)
    assert got["1", "Phone", 1] == (at(3), None, "7", True) and got["2", "Phone", 1][2:] == ("", True)
    per = {c.record_id: c for c in h.changes_per_record(history).collect()}
    assert (per["1"].n_corrections, per["1"].n_fields, per["1"].n_users, per["1"].n_breaks, per["1"].changed_fields) == (5, 2, 2, 1, "Phone,Surname")
    assert (per["2"].n_breaks, per["2"].first) == (0, at(4))


def test_values_and_states_at_a_time(spark, history):
    values = lambda m: {(c.record_id, c.field): c.value for c in h.values_at(history, F.lit(at(m))).collect()}
    assert values(-1) == {} and values(4) == {("1", "Surname"): "A", ("1", "Phone"): "7", ("2", "Phone"): ""} and values(9)["1", "Surname"] == "C"
    now = spark.createDataFrame([(1, {"Surname": "C", "Phone": "7", "Email": "e"}), (2, {"Phone": ""}), (3, {"Phone": "9"})], "id long, fields map<string, string>")
    state = lambda m: {c.id: c.fields for c in h.state_at(now, history, F.lit(at(m))).collect()}
    assert state(9) == {1: {"Surname": "C", "Phone": "7", "Email": "e"}, 2: {"Phone": ""}, 3: {"Phone": "9"}}
    assert state(8)[1]["Surname"] == "X" and state(3.5)[2] == {"Phone": "1"} and state(-5)[1]["Surname"] == ""


def test_the_audit_report_tells_what_was_changed(spark):
    lines = [
        "2026-01-01 08:00:00 event=field_corrected user=u record_id=5 field=Surname old=A new=\"B C\"",
        "2026-01-01 08:01:00 event=field_corrected user=v record_id=5 field=Surname old=X new=D",
        "2026-01-01 08:01:00 event=field_corrected user=v field=Surname old=X new=D", "2026-01-01 08:02:00 event=record_saved user=v record_id=6",
    ]
    report = audit_report(spark.createDataFrame([(line,) for line in lines], "value string"))
    [got] = report.changes.collect()
    assert (got.record_id, got.n_corrections, got.n_users, got.n_breaks, got.changed_fields) == ("5", 2, 2, 1, "Surname")


def test_several_reports_parse_the_lines_once(spark):
    lines = [
        "2026-01-01 08:00:00 event=field_corrected user=u record_id=5 field=Surname old=A new=\"B C\"", "2026-01-01 08:01:00 event=print_rendered user=v",
        "2026-01-01 08:02:00 event=record_saved user=v record_id=6", "rest of a line",
    ]
    table = spark.createDataFrame([(line,) for line in lines], "value string")
    for each, once in zip(audit_report(table), audit_report(table, several=True)):
        assert sorted(each.collect()) == sorted(once.collect()) != []
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan(once)


def test_late_and_repeated_events_of_a_stream(spark, tmp_path):
    def events(*rows):
        return [(i, at(m), e, "u", rec) for i, m, e, rec in rows]

    parts = [
        events((1, 0, "print_rendered", "5"), (2, 10, "print_rendered", "6"), (3, 20, "form_rendered", None), (2, 10, "print_rendered", "6")),
        events((4, 30, "print_dispatched", "5"), (5, 90, "print_dispatched", "6"), (6, 15, "receipt_rendered", "5"), (1, 0, "print_rendered", "5")),
        events((7, 40, "receipt_dispatch_failed", "5"), (8, 50, "receipt_dispatched", "5"), (9, 25, "form_dispatched", None), (9, 25, "form_dispatched", None)),
        events((10, 3000, "record_saved", "5"), (11, 3000, "print_rendered", "9")),
        events((12, 9000, "print_rendered", "10")),
    ]
    for part in parts:
        spark.createDataFrame(part, p.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        p.stream_previews(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), watermark="2 hours").awaitTermination()
    batch = p.first_answers(p.preview_answers(spark.createDataFrame([e for part in parts for e in part], p.EVENTS)))
    want = {c.preview_id: (c.step, c.open) for c in batch.where("preview_id < 12").collect()}
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert {c.preview_id: (c.step, c.open) for c in p.first_answers(streamed).collect()} == want
    assert want == {1: ("dispatched", False), 2: (None, True), 3: ("dispatched", False), 6: ("dispatch_failed", False), 11: (None, True)}
    assert streamed.count() == streamed.distinct().count()


def test_a_preview_keeps_only_its_first_answer(spark, tmp_path):
    """Many previews and answers of one record: as many rows as previews, not pairs."""
    rng = random.Random(3)
    rows = [(n, at(rng.randrange(600)), rng.choice(["print_rendered", "print_dispatched", "print_dispatch_failed"]), "u", rng.choice(["5", "5", None])) for n in range(600)]
    rows += [(10**6, at(10_000), "record_saved", "u", "5")]
    want = {}
    for n, t, event, _, record in rows[:-1]:
        if event.endswith("rendered"):
            answers = [(a[1], a[2][6:]) for a in rows if a[2] in ("print_dispatched", "print_dispatch_failed") and a[4] == record and t <= a[1] <= t + timedelta(minutes=7)]
            want[n] = min(answers, default=(None, None))
    events = spark.createDataFrame(rows, p.EVENTS)
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).unionByName(events.where("event_id % 7 = 0")).write.mode("append").parquet(str(tmp_path / "in"))
        p.stream_previews(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "INTERVAL 7 MINUTES", "20 days").awaitTermination()
    spark.createDataFrame([(10**6 + 1, at(100_000), "record_saved", "u", "5")], p.EVENTS).write.mode("append").parquet(str(tmp_path / "in"))
    p.stream_previews(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "INTERVAL 7 MINUTES", "20 days").awaitTermination()
    for answers in (p.preview_answers(events, "INTERVAL 7 MINUTES"), spark.read.parquet(str(tmp_path / "out"))):
        got = answers.collect()
        assert {c.preview_id: (c.answered, c.step) for c in got} == want and len(got) == len(want) > 150
        assert {c.preview_id: (c.answered, c.step) for c in p.first_answers(answers).collect()} == want


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcABé 1.#") for _ in range(rng.randint(0, 12)))
    rows = [(rng.randrange(10**6) if k else 7, f"2026-01-{k % 28 + 1:02d}T08:00:00", {"Surname": word(), "Phone": word() or None, "e": str(k)}) for k in range(300)]
    rows = list({row[0]: row for row in rows}.values())
    records = spark.createDataFrame(rows, "id long, created_at string, fields map<string, string>")
    x.write_index(records.where("id % 2 = 0"), str(tmp_path / "i"))
    x.write_index(records.where("id % 2 = 1"), str(tmp_path / "i"))
    # a record that was changed and indexed again, its old postings stay
    changed = records.where("id = 7").withColumn("fields", F.create_map(F.lit("Surname"), F.lit("only here")))
    x.write_index(changed, str(tmp_path / "i"))
    now = records.where("id <> 7").unionByName(changed)
    index = spark.read.parquet(str(tmp_path / "i"))
    texts = [v for row in rows for v in row[2].values() if v and len(v) > 4]
    needles = ["", "a", "ab", "ONLY", "2026-01-2", "zzz", "nly her"] + [t[s : s + rng.randint(3, 6)] for t in rng.sample(texts, 8) for s in (rng.randrange(2),)]
    ids = lambda df: sorted(c.id for c in df.select("id").collect())
    for needle in needles:
        assert ids(x.indexed_search(now, index, needle)) == ids(r.search_records(now, needle)), needle
    assert x.candidates(index, "only here").count() == 1 and x.candidates(index, "zzz").count() == 0


def test_a_common_gram_is_a_bounded_row(spark, tmp_path):
    ids = [-(2**63), -65, -1, 2**53 + 1, 2**63 - 1]
    records = spark.range(70_000).unionByName(spark.createDataFrame([(i,) for i in ids], "id long")).selectExpr(
        "id", "'2026-01-01' AS created_at", "map('Surname', 'common') AS fields")
    for half in (0, 1):
        x.write_index(records.where(F.pmod("id", F.lit(2)) == half), str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    # the longest row of a gram that all records hold, in values
    longest = F.max(F.coalesce(*[F.size(c) for c, t in index.dtypes if t.startswith("array")]))
    assert index.where("gram = 'com'").agg(longest).first()[0] <= x.SLICE // 32
    found = x.candidates(index, "common")
    assert found.count() == 70_005 and found.join(records, "id").count() == 70_005


def test_a_needle_reads_few_postings(spark, tmp_path):
    records = spark.range(50_000).selectExpr("id", "'2026-01-01' AS created_at", "map('Surname', sha2(cast(id AS string), 256)) AS fields")
    x.write_index(records, str(tmp_path / "i"))
    found = x.candidates(spark.read.parquet(str(tmp_path / "i")), "abcdef")
    assert found.count() < 50_000 * 0.02
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [abc,bcd,cde,def])" in text

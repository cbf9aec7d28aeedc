"""Work folders, saving with new records, dirty dumps, compaction."""

import glob
import os

from pyspark.sql import functions as F

from docreg.common import drop_folder, job_folder, reliable
from docreg.operators import registry as r
from docreg.plans.save_batch import save_batch
from docreg.plans.source_merge import merge_errors, merge_sources
from docreg.sources import images, word_dumps
from docreg.sources.records import encode_records

RECORD = "id long, created_at string, fields map<string, string>"


def test_a_job_writes_into_one_folder_that_can_be_dropped(spark):
    with job_folder(spark) as folder:
        table = reliable(spark.range(5))
        assert table.count() == 5
    local = folder.removeprefix("file://")
    assert glob.glob(f"{local}/step-*/part-*")
    assert not reliable(spark.range(1)).inputFiles()[0].removeprefix("file://").startswith(local)
    drop_folder(spark, folder)
    assert not os.path.exists(local)


def fields(surname, number="N"):
    return {"Surname": surname, "Issued Document.Number": number}


def test_save_batch_inserts_updates_and_rejects(spark):
    base = spark.createDataFrame([(1, "2026-01-01T08:00:00", fields("A")), (7, "2026-01-01T08:00:00", fields("B"))], RECORD)
    batch = [(1, 1, None, fields("A1")), (1, 2, None, fields("A2")), (None, 1, 5, fields("NEW")), (None, 1, 2, fields("", "N")), (9, 1, None, fields("X"))]
    saved = save_batch(base, spark.createDataFrame(batch, "id long, version long, seq long, fields map<string, string>"), "u", "2026-01-02T09:00:00")
    got = {x.id: (x.created_at, x.fields["Surname"]) for x in saved.records.collect()}
    assert got == {1: ("2026-01-01T08:00:00", "A2"), 7: ("2026-01-01T08:00:00", "B"), 8: ("2026-01-02T09:00:00", "NEW")}
    assert sorted((str(x.id), x.reason) for x in saved.rejects.collect()) == [("9", "unknown id"), ("None", "Surname is required")]
    assert [(x.id, x.field, x.old, x.new) for x in saved.diffs.collect()] == [(1, "Surname", "A", "A2")]
    lines = sorted(x.value for x in saved.lines.collect())
    assert len(lines) == 3 and "record_id=8 mode=insert changed_field_count=0" in lines[2] and "field=Surname old=A new=A2" in lines[0]


def test_repeated_changes_without_version_are_rejected(spark):
    base = spark.createDataFrame([(1, "t", fields("A"))], RECORD)
    changes = spark.createDataFrame([(1, fields("A1")), (1, fields("A2"))], "id long, fields map<string, string>")
    new, rejected = r.upsert_records(base, changes)
    assert [(x.id, x.fields["Surname"]) for x in new.collect()] == [(1, "A")] and rejected.count() == 2
    assert {x.reason for x in save_batch(base, changes).rejects.collect()} == {"repeated id"}


def test_numbers_and_neighbours_of_sparse_ids(spark):
    ids = [-5, 3, 4, 1 << 40, (1 << 40) + 1, 1 << 62, 17]
    records = spark.createDataFrame([(i, None) for i in ids], "id long, number string")
    order = sorted(ids)
    for id_slice in (r.ID_SLICE, 5):
        got = {x.id: (x.previous_id, x.next_id) for x in r.neighbours(records, id_slice).collect()}
        assert got == {i: (order[k - 1] if k else None, order[k + 1] if k + 1 < len(order) else None) for k, i in enumerate(order)}
        numbered = r.assign_numbers(records, "number", id_slice=id_slice)
        assert {x.id: x.number for x in numbered.collect()} == {i: f"{k:06d}" for k, i in enumerate(order, 1)}


def test_no_window_over_all_ids(spark):
    plan = r.neighbours(spark.range(10))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 + r._levels(r.ID_SLICE)


def test_broken_dumps_are_listed_with_their_text(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    good = '[{"text":"a","confidence":0.5,"box":[0,1,2,3]}]'
    for name, text in (("good", good), ("cut", good[:-5]), ("corner", good.replace("[0,1,2,3]", "[0,1]")), ("empty", "[]")):
        (tmp_path / "run1" / f"{name}_words.json").write_text(text)
    assert [(x.run, x.region, x.text) for x in word_dumps.read_word_dumps(spark, str(tmp_path)).collect()] == [("run1", "good", "a")]
    bad = {(x.region, x.value) for x in word_dumps.bad_word_dumps(spark, str(tmp_path)).collect()}
    assert bad == {("cut", good[:-5]), ("corner", good.replace("[0,1,2,3]", "[0,1]"))}


def test_dumps_are_one_folder_per_run(spark, tmp_path):
    words = spark.range(40).selectExpr("'r' AS run", "CAST(id % 8 AS STRING) AS region", "id AS word_no", "'w' AS text", "0.5D AS conf", "0 AS x0", "0 AS y0", "1 AS x1", "1 AS y1")
    word_dumps.write_word_dumps(words.coalesce(2), str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out" / "run=r") and not glob.glob(f"{tmp_path}/out/*/region=*")
    assert word_dumps.read_word_dumps(spark, str(tmp_path / "out")).count() == 40


def test_the_key_is_not_in_the_plan(spark):
    records = spark.createDataFrame([(1, "t", fields("A"))], RECORD)
    stored = encode_records(records, "0123456789abcdef")
    assert "0123456789abcdef" not in stored._jdf.queryExecution().toString()
    assert stored.first().payload is not None


def test_list_and_search_on_time_stamps(spark):
    records = spark.sql("SELECT 1L AS id, timestamp'2026-01-01 08:00:00' AS created_at, map('Surname','A') AS fields")
    assert r.list_view(records).first().created == "2026-01-01"
    assert r.search_records(records, "01T08").count() == 1 and r.search_records(records, "01 08").count() == 0


def test_an_application_with_only_a_failed_front(spark):
    passport = spark.createDataFrame([], "app_id long, surname string, given_names string, names_flagged boolean, date_of_birth string, birth_valid boolean, father_name string, father_flagged boolean, place_of_birth string, place_flagged boolean")
    reads = spark.createDataFrame([], "app_id long, field_key string, value string, flagged boolean")
    back = spark.createDataFrame([], "app_id long, classes string, flagged boolean, error string")
    front = spark.createDataFrame([(5, "no card found")], "app_id long, error string")
    assert merge_errors(passport, reads, back, front).first().errors == ["License front: no card found"]
    form = merge_sources(passport, reads, back, front)
    assert form.select("app_id").distinct().first()[0] == 5 and form.where(F.col("value") != "").isEmpty()


def test_a_reader_that_returns_no_words_is_an_error_row(spark):
    def read(content):
        yield {b"a": ("w", 0.5, 0, 0, 1, 1), b"b": ("w", 0.5, 1.5, 0, 1, 1), b"c": ("w", "x", 0, 0, 1, 1), b"d": (7, 0.5, 0, 0, 1, 1)}[content]

    files = spark.createDataFrame([(k, k.encode()) for k in "abcd"], "path string, content binary")
    words, errors = images.split_reads(images.extract_words(files, read))
    assert [x.path for x in words.collect()] == ["a"] and sorted(x.path for x in errors.collect()) == ["b", "c", "d"]

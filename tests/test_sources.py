"""Files in and out, and streams that equal their batch."""

import json

from pyspark.sql import functions as F

from docreg.operators import audit, registry as r
from docreg.sources import annotations, audit_log, images, intake, records, word_dumps
from docreg.streaming import audit_stream, record_stream


def test_word_dump_files(spark, tmp_path):
    run = tmp_path / "20260101_080000"
    run.mkdir()
    words = [{"text": "ONE", "confidence": 0.987, "box": [1, 2, 30, 14]}, {"text": "\u00c9T\u00c9", "confidence": 0.5, "box": [40, 2, 60, 14]}]
    (run / "front_13b_words.json").write_text(json.dumps(words, indent=2, ensure_ascii=False), encoding="utf-8")
    rows = word_dumps.read_word_dumps(spark, str(tmp_path)).orderBy("word_no").collect()
    assert [tuple(x) for x in rows] == [
        ("20260101_080000", "front_13b", 0, "ONE", 0.987, 1, 2, 30, 14),
        ("20260101_080000", "front_13b", 1, "\u00c9T\u00c9", 0.5, 40, 2, 60, 14),
    ]


def test_word_dumps_come_back(spark, tmp_path):
    words = spark.createDataFrame(
        [("r 1", "a/b", 0, "x", 0.12349, 0, 1, 2, 3), ("r 1", "a/b", 1, "y", 1.0, 4, 5, 6, 7), ("r2+", "c", 0, "z", 0.5, 0, 0, 1, 1)],
        "run string, region string, word_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int",
    )
    word_dumps.write_word_dumps(words, str(tmp_path / "d"))
    back = word_dumps.read_word_dumps(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, words.withColumn("conf", F.round("conf", 3)).collect()))


def test_annotations(spark):
    word = lambda text, conf, *corners: {
        "symbols": [{"text": t} for t in text], "confidence": conf,
        "bounding_box": {"vertices": [{"x": x, "y": y} for x, y in corners]},
    }
    paragraph = {"words": [word("AB", 1.5, (9, 8), (20, 7), (21, 19), (8, 20)), word("", 0.9, (0, 0)), word("C", -1.0, (1, 1), (2, 2))]}
    page = lambda text: {"text": text, "pages": [{"blocks": [{"paragraphs": [paragraph]}, {"paragraphs": []}]}]}
    lines = [json.dumps({"doc_id": 1, "annotation": page("AB C")}), json.dumps({"doc_id": 2, "annotation": page("")})]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    nested = df.select(F.from_json("line", f"doc_id long, annotation {annotations.ANNOTATION}").alias("j")).select("j.*")
    got = annotations.flatten_annotations(nested).collect()
    assert [tuple(x) for x in got] == [(1, 0, "AB", 1.0, 8, 7, 21, 20), (1, 1, "C", 0.0, 1, 1, 2, 2)]


def test_intake_from_files(spark, tmp_path):
    for app, kinds in {"7": ["passport", "front", "back"], "8": ["front", "other"]}.items():
        (tmp_path / app).mkdir()
        for kind in kinds:
            (tmp_path / app / f"{kind}.png").write_bytes(b"x")
    status = intake.intake_status(intake.list_manifest(spark, str(tmp_path)))
    assert {x.app_id: (x.complete, x.missing) for x in status.collect()} == {"7": (True, ""), "8": (False, "passport,back")}


def test_records_round_trip(spark, tmp_path):
    rows = [(1, "2026-01-01T08:00:00", {"Surname": "\u00c9l \u0645 \"q\" \\ \n", "Empty": ""})]
    df = spark.createDataFrame(rows, "id long, created_at string, fields map<string, string>")
    for name, key in (("plain", None), ("secret", "0123456789abcdef")):
        records.write_records(df, str(tmp_path / name), key)
        assert records.read_records(spark, str(tmp_path / name), key).collect() == df.collect()
    stored = spark.read.parquet(str(tmp_path / "secret")).collect()[0].payload
    assert b"Surname" not in bytes(stored)


VALUES = ["", "plain", "two words", 'say "hi"', "C:\\dir\\new", "C:\\my dir\\new", "line\nbreak", "back\\n slash", 'a=1 b="2"', "x=y", "end \\", "\r"]


def test_audit_lines_come_back(spark, tmp_path):
    rows = [("2026-01-01 08:00:00", "e", f"u{i}", v, v) for i, v in enumerate(VALUES)]
    events = spark.createDataFrame(rows, "ts string, event string, user string, note string, other string").withColumn("ts", F.col("ts").cast("timestamp"))
    audit.format_audit(events, ["event", "user", "note", "other"]).write.text(str(tmp_path / "log"))
    back = audit_log.read_audit(spark, str(tmp_path / "log")).collect()
    assert {x.user: (x.attrs["note"], x.attrs["other"], len(x.attrs)) for x in back} == {f"u{i}": (v, v, 2) for i, v in enumerate(VALUES)}
    assert not any(x.malformed for x in back)


def test_old_audit_lines(spark):
    lines = ['2026-01-01 08:00:00 event=e user=u path=C:\\new note="my \\"x\\" C:\\new" empty=""', "rest of a broken line"]
    got = audit_log.parse_audit(spark.createDataFrame([(l,) for l in lines], "value string")).collect()
    assert got[0].attrs == {"path": "C:\\new", "note": 'my "x" C:\\new', "empty": ""}
    assert got[1].malformed and got[1].event is None


def reader():
    def read(content):
        if content == b"bad":
            raise ValueError("cannot read")
        return [(t, 0.9, 0, 0, 10, 10) for t in content.decode().split()]

    return read


def test_reader_failures_become_rows(spark, tmp_path):
    for name, content in {"a.png": b"one two", "b.png": b"bad", "c.png": b""}.items():
        (tmp_path / name).write_bytes(content)
    words, errors = images.split_reads(images.extract_words(images.image_files(spark, str(tmp_path)), reader()))
    assert sorted((x.path[-5:], x.word_no, x.text) for x in words.collect()) == [("a.png", 0, "one"), ("a.png", 1, "two")]
    assert [(x.path[-5:], x.error) for x in errors.collect()] == [("b.png", "cannot read")]


def test_audit_stream_reads_each_file_once(spark, tmp_path):
    src, dst, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    lines = lambda a, b: spark.range(a, b).selectExpr("concat('2026-01-0', 1 + id % 3, ' 08:00:00 event=e user=u', id) AS value")
    lines(0, 20).repartition(4).write.text(src)
    audit_stream.stream_audit(spark, src, dst, state, files_per_batch=2).awaitTermination()
    audit_stream.stream_audit(spark, src, dst, state).awaitTermination()
    assert spark.read.parquet(dst).count() == 20
    lines(20, 25).write.mode("append").text(src)
    audit_stream.stream_audit(spark, src, dst, state).awaitTermination()
    users = sorted(x.user for x in spark.read.parquet(dst).collect())
    assert users == sorted(f"u{i}" for i in range(25))


def test_record_stream_equals_batch(spark, tmp_path):
    root = str(tmp_path)
    base = spark.range(10).selectExpr("id", "'2026-01-01T08:00:00' AS created_at", "map('Surname', 'old', 'Gone', 'x') AS fields")
    base.write.parquet(f"{root}/base")
    changes = spark.range(40).selectExpr("id % 13 AS id", "id AS version", "timestamp_seconds(id) AS ts", "map('Surname', concat('v', id)) AS fields")
    changes.repartition(6).write.parquet(f"{root}/in")
    for _ in range(2):  # the second run finds nothing new
        record_stream.stream_records(spark, f"{root}/in", root, f"{root}/state", files_per_batch=1).awaitTermination()
    known, unknown = r.upsert_records(base, r.latest_records(changes).select("id", "fields"))
    key = lambda df: sorted((x.id, x.created_at, tuple(sorted(x.fields.items()))) for x in df.collect())
    assert key(record_stream.current_records(spark, root)) == key(known)
    assert {x.id for x in record_stream.rejected_changes(spark, root).collect()} == {x.id for x in unknown.collect()} == {10, 11, 12}

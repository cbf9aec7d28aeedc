"""Logs that grow, rotate and break lines."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from docreg.sources import audit_log
from docreg.sources.commits import last_version, version_path
from docreg.streaming.log_ingest import ingest_logs, ingested_events


def line(second, note, quoted=False):
    note = f'"{note}"' if quoted else note
    return f"2026-01-01 08:00:{second:02d} event=record_opened user=u note={note}"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs" / "host1").mkdir(parents=True)
    return tmp_path


def append(path, *lines, end="\n"):
    with open(path, "ab") as file:
        file.write(("\n".join(lines) + end).encode())


def rotate(live, keep=5):
    for i in reversed(range(1, keep)):
        if os.path.exists(f"{live}.{i}"):
            shutil.move(f"{live}.{i}", f"{live}.{i + 1}")
    shutil.move(live, f"{live}.1")


def notes(spark, dst):
    rows = ingested_events(spark, dst).select("log", "version", "seq", "line_no", audit_log.attr("note"), "malformed", "line").collect()
    rows.sort(key=lambda r: (r.log, r.seq, r.version, r.line_no))
    return [r.line if r.malformed else r.note for r in rows]


def test_each_line_once_while_the_log_grows_and_rotates(spark, folder):
    live, dst = str(folder / "logs" / "host1" / "audit.log"), str(folder / "out")
    take = lambda: ingest_logs(spark, str(folder / "logs"), dst)
    append(live, line(1, "a"), line(1, "a"), "2026-01-01 08:00:02 event=rec", end="")
    assert take() == 0 and notes(spark, dst) == ["a", "a"]
    assert take() == 0  # no news, no run
    append(live, "ord_opened user=u note=b", line(2, "c"))
    assert take() == 1 and notes(spark, dst) == ["a", "a", "b", "c"]
    # grows, is renamed, and a new one begins with the same line as the old
    append(live, line(3, "d"))
    rotate(live)
    append(live, line(1, "a"), line(4, "é ü", True))
    assert take() == 2 and notes(spark, dst) == ["a", "a", "b", "c", "d", "a", "é ü"]
    # renamed twice without news in between
    rotate(live)
    append(live, line(5, "f"))
    rotate(live)
    append(live, line(6, "g"))
    os.remove(f"{live}.3")
    assert take() == 3 and notes(spark, dst) == ["a", "a", "b", "c", "d", "a", "é ü", "f", "g"]
    # a touched file is no news
    os.utime(f"{live}.2", (1, 1))
    assert take() == 4 and notes(spark, dst) == ["a", "a", "b", "c", "d", "a", "é ü", "f", "g"]


def test_equal_files_of_one_moment(spark, folder):
    live, dst = str(folder / "logs" / "host1" / "audit.log"), str(folder / "out")
    append(live, line(1, "a"))
    os.utime(live, (1000, 1000))
    ingest_logs(spark, str(folder / "logs"), dst)
    rotate(live)
    append(live, line(1, "a"))
    os.utime(live, (1000, 1000))
    append(str(folder / "logs" / "other.log"), line(1, "a"))
    ingest_logs(spark, str(folder / "logs"), dst)
    assert notes(spark, dst) == ["a", "a", "a"]


def test_broken_lines_and_open_quotes(spark, folder):
    live, dst = str(folder / "logs" / "audit.log"), str(folder / "out")
    append(live, "rest of nothing", line(1, "one\ntwo\r\n2 three", True), '2026-01-01 08:00:02 event=record_opened user=u note="open')
    ingest_logs(spark, str(folder / "logs"), dst)
    assert notes(spark, dst) == ["rest of nothing", "one\ntwo\r\n2 three"]
    append(live, 'closed" x=1', line(3, "last"))
    ingest_logs(spark, str(folder / "logs"), dst)
    assert notes(spark, dst) == ["rest of nothing", "one\ntwo\r\n2 three", "open\nclosed", "last"]


def test_a_killed_run_is_repeated(spark, folder):
    live, dst = str(folder / "logs" / "audit.log"), str(folder / "out")
    append(live, line(1, "a"))
    ingest_logs(spark, str(folder / "logs"), dst)
    append(live, line(2, "b"))
    assert ingest_logs(spark, str(folder / "logs"), dst) == 1
    # killed after the events, before the commit
    os.remove(f"{version_path(dst + '/offsets', 1)}/_SUCCESS")
    assert last_version(spark, f"{dst}/offsets") == 0 and notes(spark, dst) == ["a"]
    append(live, line(3, "c"))
    assert ingest_logs(spark, str(folder / "logs"), dst) == 1 and notes(spark, dst) == ["a", "b", "c"]


def test_events_over_splits_come_back_whole(spark, tmp_path):
    texts = [f"first {i}\nsecond {i}\n\nlast" if i % 3 == 0 else f"plain {i}" for i in range(400)]
    path = tmp_path / "logs"
    path.mkdir()
    (path / "old.log").write_text("\n".join(line(i % 60, t, True) for i, t in enumerate(texts)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.minPartitionNum", "40")
    try:
        lines = audit_log.numbered_lines(spark, str(path))
        assert lines.select("block").distinct().count() > 20
        events = audit_log.parse_audit(audit_log.whole_events(lines)).select(audit_log.attr("note"), "malformed").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert not any(e.malformed for e in events) and sorted(e.note for e in events) == sorted(texts)


def test_lines_before_any_event_are_kept(spark, tmp_path):
    (tmp_path / "a.log").write_text("half\nother half\n" + line(1, "x") + "\n")
    got = audit_log.read_audit(spark, str(tmp_path)).select("malformed", "line", audit_log.attr("note")).collect()
    assert sorted((r.malformed, r.line, r.note) for r in got if r.malformed) == [(True, "half", None), (True, "other half", None)]
    assert [r.note for r in got if not r.malformed] == ["x"]

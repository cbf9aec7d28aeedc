"""What the plans may and may not contain."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from docreg.operators import registry as r, words as w
from docreg.operators.labels import bands_below
from docreg.plans.mrz_validation import read_zones
from docreg.plans.text_lines import text_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("words") / "w")
    spark.range(2000).selectExpr(
        "id % 20 AS doc_id", "id AS word_no", "'w' AS text", "0.9D AS conf", "CAST(id AS INT) AS x0", "CAST(id % 50 * 20 AS INT) AS y0",
        "CAST(id + 30 AS INT) AS x1", "CAST(id % 50 * 20 + 12 AS INT) AS y1", "'unused' AS other",
    ).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(text_lines(stored.drop("other")))
    assert "GreaterThanOrEqual(conf,0.6)" in text and "other" not in text
    schema = plan(w.avg_confidence(stored, stored.select("doc_id").distinct()))
    assert "ReadSchema: struct<doc_id:bigint,conf:double>" in schema


def test_no_pairing_without_a_key(stored):
    lines = stored.selectExpr("doc_id", "'l' AS label", "x0", "y0", "x1", "y1", "12 AS height")
    boxes = stored.selectExpr("doc_id", "struct(0D AS less, word_no AS no) AS rank", "x0", "y0", "x1", "y1")
    plans = [
        plan(text_lines(stored)), plan(w.words_in_bands(stored, bands_below(lines), ["doc_id"])),
        plan(w.overlapping_pairs(boxes, ["doc_id"], 0.5)),
    ]
    assert not any(bad in text for text in plans for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"))


def test_zones_need_no_shuffle(spark):
    pages = spark.range(10).selectExpr("id AS doc_id", "CAST(id AS STRING) AS full_text")
    assert "Exchange" not in plan(read_zones(pages, date(2026, 1, 1)))


def test_latest_version_combines_before_the_shuffle(spark):
    log = spark.range(100).selectExpr("id % 3 AS id", "id AS version", "timestamp_seconds(id) AS ts", "map('a', 'b') AS fields")
    text = plan(r.latest_records(log))
    assert "partial_max_by" in text and text.count("Exchange hashpartitioning") <= 2 and "Window" not in text


def test_broadcasts_are_of_fixed_size(stored):
    """Tables that grow are joined without a hint."""
    new, _ = r.upsert_records(
        stored.selectExpr("word_no AS id", "'t' AS created_at", "map('a', 'b') AS fields"),
        stored.selectExpr("word_no AS id", "map('a', 'c') AS fields"),
    )
    assert "ResolvedHint" not in new._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("derived, key", [("label_words", "doc_id"), ("card_words", "doc_id"), ("back_words", "doc_id"), ("source_reads", "app_id"), ("record_changes", "id")])
def test_rows_are_dealt_before_they_become_many(spark, derived, key):
    """A small file is one split: its words must not all be sorted by the task that reads it."""
    made = getattr(inputs, derived)(spark, SF).select(key, F.spark_partition_id().alias("part")).distinct()
    assert made.select("part").distinct().count() > 1
    assert made.groupBy(key).count().where("count > 1").isEmpty()


def test_pages_dealt_out_pair_their_boxes_without_a_shuffle(stored):
    """Neither the copies of a box, nor its cells, nor further detections are dealt out anew."""
    boxes = stored.selectExpr("doc_id", "struct(0D AS less, word_no AS no) AS rank", "x0", "y0", "x1", "y1")
    assert plan(w.overlapping_pairs(boxes.repartition(5, "doc_id"), ["doc_id"], 0.5)).count("Exchange hashpartitioning") == 1
    assert plan(inputs.doubled(stored.sparkSession, SF).groupBy("doc_id", "x0").count()).count("Exchange hashpartitioning") == 1

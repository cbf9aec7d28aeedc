"""Registry rules that whole-table queries do not reach."""

import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from docreg.operators import accounts, registry as r
from docreg.plans import number_ledger as ledger
from docreg.plans.save_batch import save_batch
from docreg.plans.source_merge import merge_sources


@pytest.fixture
def records(spark):
    def make(*rows):
        return spark.createDataFrame([(i, f"2026-01-0{i}T08:00:00", f) for i, f in rows], "id long, created_at string, fields map<string, string>")

    return make


GOOD = {"Surname": "ONE", "Issued Document.Number": "D-1", "Phone": "7"}


def test_a_change_replaces_the_whole_map(records):
    base = records((1, GOOD), (2, GOOD))
    saved = save_batch(base, records((1, {"Surname": "TWO", "Issued Document.Number": "D-1"}), (3, GOOD)).select("id", "fields"))
    by_id = {x.id: x for x in saved.records.collect()}
    assert by_id[1].fields == {"Surname": "TWO", "Issued Document.Number": "D-1"}
    assert by_id[1].created_at == "2026-01-01T08:00:00" and by_id[2].fields == GOOD
    assert [tuple(x) for x in saved.diffs.collect()] == [(1, "Surname", "ONE", "TWO")]
    assert [(x.id, x.reason) for x in saved.rejects.collect()] == [(3, "unknown id")]


def test_upsert_twice_is_upsert_once(records):
    base, change = records((1, GOOD)), records((1, {"Surname": "X"})).select("id", "fields")
    once = r.upsert_records(base, change)[0]
    assert r.upsert_records(once, change)[0].collect() == once.collect()


def test_first_reason_names_the_surname(records):
    valid, rejected = r.validate_records(records((1, {}), (2, {"Surname": "A"}), (3, {"Surname": "\t", "Issued Document.Number": "1"}), (4, GOOD)))
    assert [x.id for x in valid.collect()] == [4]
    reasons = {x.id: x.reason for x in rejected.collect()}
    assert reasons[1] == reasons[3] == r.REQUIRED["Surname"] and reasons[2] == r.REQUIRED["Issued Document.Number"]


@pytest.mark.parametrize("needle, ids", [("", [1, 2]), ("  one ", [1]), ("-02T", [2]), ("Surname", []), ("2", [1, 2])])
def test_search_looks_at_values_only(records, needle, ids):
    found = r.search_records(records((1, GOOD), (2, {"Surname": "TWO"})), needle)
    assert sorted(x.id for x in found.collect()) == ids


def test_numbers_across_slices(spark):
    rows = spark.range(0, 3000, 7).withColumn("receipt", F.when(F.col("id") % 3 == 0, "kept").otherwise(" "))
    got = r.assign_numbers(rows, "receipt", start=5, prefix="N", id_slice=100).orderBy("id").collect()
    fresh = [x.receipt for x in got if x.receipt != "kept"]
    assert fresh == [f"N{n:06d}" for n in range(5, 5 + len(fresh))]
    assert sum(x.receipt == "kept" for x in got) == sum(i % 3 == 0 for i in range(0, 3000, 7))


def test_numbers_grow_beyond_six_digits(spark):
    rows = spark.range(3).withColumn("n", F.lit(""))
    got = r.assign_numbers(rows, "n", start=999_999).orderBy("id").collect()
    assert [x.n for x in got] == ["999999", "1000000", "1000001"]


def test_neighbours_across_empty_slices(spark):
    got = r.neighbours(spark.createDataFrame([(5,), (50_000,), (50_001,)], "id long"), id_slice=10).orderBy("id").collect()
    assert [tuple(x) for x in got] == [(5, None, 50_000), (50_000, 5, 50_001), (50_001, 50_000, None)]


def test_clone_keeps_the_rest(records, spark):
    ids = spark.createDataFrame([(1,)], "id long")
    clone = r.clone_records(records((1, {**GOOD, "Receipt.Number": "9"})), ids, date(2026, 2, 3), "u").collect()[0]
    assert clone.source_id == 1
    assert clone.fields == {"Surname": "ONE", "Phone": "7", "Issued Document.Number": "", "Issued Document.Date": "03/02/2026",
                            "Receipt.Date": "", "Receipt.Number": "", "Receipt.User": "u"}


def test_last_admin(spark):
    one = spark.createDataFrame([("Ann ", True), ("ann", False), ("Bob", False)], "username string, is_admin boolean")
    checks = {x.name: (x.n, x.duplicate, x.last_admin) for x in accounts.account_checks(one).collect()}
    assert checks == {"ann": (2, True, True), "bob": (1, False, False)}


def test_missing_sides_leave_marked_blanks(spark):
    passport = spark.createDataFrame(
        [(1, "S", "G", False, "01/01/1990", True, "F", False, "T", False)],
        "app_id long, surname string, given_names string, names_flagged boolean, date_of_birth string, birth_valid boolean,"
        "father_name string, father_flagged boolean, place_of_birth string, place_flagged boolean",
    )
    reads = spark.createDataFrame([(2, "1", "L", True), (2, "3", "1990 TOWN", False)], "app_id long, field_key string, value string, flagged boolean")
    back = spark.createDataFrame([(1, "B", False, None), (2, "", True, "unreadable")], "app_id long, classes string, flagged boolean, error string")
    form = {(x.app_id, x.field_key): (x.value, x.flagged, x.source) for x in merge_sources(passport, reads, back).collect()}
    assert form[1, "Surname"] == ("S", False, "passport") and form[2, "Surname"] == ("L", True, "license")
    assert form[2, "Date of B."] == ("1990 TOWN", True, "license") and form[1, "Date of B."] == ("01/01/1990", False, "passport")
    assert form[1, "Address"] == ("", True, "") and form[2, "First Name"] == ("", True, "")
    assert form[1, "Original Document.Category"] == ("B", False, "license")
    assert form[2, "Original Document.Category"] == ("", True, "")
    assert form[1, "Phone"] == ("", False, "")


def test_numbers_in_use_are_not_given_again(spark):
    rows = spark.createDataFrame([(1, "000007"), (2, ""), (3, "IDL-000900"), (4, None), (5, "12x")], "id long, n string")
    assert [x.n for x in r.assign_numbers(rows, "n").orderBy("id").collect()] == ["000007", "000008", "IDL-000900", "000009", "12x"]
    assert [x.n for x in r.assign_numbers(rows, "n", prefix="IDL-").orderBy("id").collect()][1] == "IDL-000901"
    assert [x.n for x in r.assign_numbers(rows, "n", start=50).orderBy("id").collect()][1] == "000050"


def test_ledger_over_batches_and_reruns(spark, tmp_path):
    root = str(tmp_path / "receipts")
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN lpad(id, 6, '0') ELSE ' ' END AS n").repartition(13)
    first, second = rows.where("id < 500"), rows.where("id >= 500")
    numbers = lambda df: {x.id: x.n for x in df.collect()}
    one = numbers(ledger.issue_numbers(first, "n", root, "a", registry=rows))
    two = numbers(ledger.issue_numbers(second, "n", root, "b", registry=rows))
    assert numbers(ledger.issue_numbers(first.repartition(3), "n", root, "a", registry=rows)) == one
    every = [*one.values(), *two.values()]
    assert len(set(every)) == len(every) == 1000
    fresh = [one[i] for i in sorted(one) if i % 10] + [two[i] for i in sorted(two) if i % 10]
    assert fresh == [f"{991 + k:06d}" for k in range(900)]
    # a number typed by hand moves the counter on; the other counter stands for itself
    typed = spark.createDataFrame([(1, "005000"), (2, "")], "id long, n string")
    assert numbers(ledger.issue_numbers(typed, "n", root, "c"))[2] == "005001"
    assert numbers(ledger.issue_numbers(typed, "n", str(tmp_path / "issued"), "a", prefix="IDL-"))[2] == "IDL-000001"
    assert [(x.batch, x.first, x.last) for x in ledger.ledger(spark, root).orderBy("first").collect()] == [("a", 991, 1440), ("b", 1441, 1890), ("c", 5001, 5001)]
    with pytest.raises(ValueError):
        ledger.issue_numbers(second.where("id < 600"), "n", root, "a")


def test_a_killed_reservation_is_made_again(spark, tmp_path):
    root = str(tmp_path / "n")
    assert ledger.reserve(spark, root, "a", 5) == 1
    assert ledger.reserve(spark, root, "b", 2) == 6
    os.remove(f"{root}/version=1/_SUCCESS")
    assert ledger.reserve(spark, root, "b", 3) == 6 and ledger.reserve(spark, root, "c", 1) == 9


def test_places_need_one_shuffle_of_the_rows(spark):
    placed = ledger.placed_rows(spark.range(100, 0, -1).repartition(9), "id")
    assert {x._place: x.id for x in placed.collect()} == {k: k + 1 for k in range(100)}
    assert ledger.placed_rows(spark.range(0), "id").count() == 0


def test_ledger_query_beyond_six_digits(spark, tmp_path):
    """Keys of more digits than a receipt shows make typed receipts that repeat; no
    number that the counter gave does."""
    import duckdb

    from catalog import registry as queries
    from tools.check import compare, connect

    small = "/root/testdata/sf0.001"
    duckdb.sql(f"COPY (SELECT * REPLACE ((o_orderkey + 10000000)::BIGINT AS o_orderkey) FROM '{small}/orders.parquet' LIMIT 60) TO '{tmp_path}/orders.parquet'")
    duckdb.sql(f"COPY (FROM '{small}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    query, sql = queries.QUERIES["w8_number_ledger"]
    ok, note = compare(query(spark, str(tmp_path)), sql, connect(str(tmp_path)))
    assert ok, note

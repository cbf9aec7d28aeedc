"""The record registry on orders and customers."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs as i
from docreg.common import blank, reliable, trimmed, work_path
from docreg.operators import accounts, registry as r, search_index
from docreg.plans.number_ledger import issue_numbers
from docreg.plans.save_batch import save_batch
from docreg.sources.record_store import RecordStore
from docreg.sources.records import read_records, write_records
from docreg.streaming import record_stream

_KEYS = {"surname": "Surname", "first_name": "First Name", "issued": "Issued Document.Number",
         "receipt": "Receipt.Number", "category": "Original Document.Category", "issued_date": "Issued Document.Date",
         "receipt_date": "Receipt.Date", "receipt_user": "Receipt.User", "payer": "Receipt.Received from"}


def _flat(records: DataFrame, *names: str) -> list:
    return [F.try_element_at("fields", F.lit(_KEYS[n])).alias(n) for n in names]


def _all_ids(spark: SparkSession, sf: str) -> DataFrame:
    return i.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")).distinct()


def _search(spark, sf):
    return r.search_records(i.records(spark, sf), " AUto ").select("id")


_NEEDLES = [" AUto ", "r#00000001", "T08:0", "d-0000", "no such text", "7", "e m"]


def _indexed(spark, sf):
    """Needles looked up in an index that was written in two batches."""
    path = work_path(spark, "grams")
    records = i.records(spark, sf)
    for half in (0, 1):
        search_index.write_index(records.where(F.col("id") % 2 == half), path)
    index = spark.read.parquet(path)
    found = [search_index.indexed_search(records, index, needle).select(F.lit(needle).alias("needle"), "id") for needle in _NEEDLES]
    return reduce(DataFrame.unionByName, found)


def _list_view(spark, sf):
    return r.list_view(i.records(spark, sf))


def _newest(spark, sf):
    return r.list_view(i.records(spark, sf), newest_first=True)


def _validate(spark, sf):
    valid, rejected = r.validate_records(i.records(spark, sf))
    return valid.select("id", F.lit("").alias("reason")).unionByName(rejected.select("id", "reason"))


def _data_page(spark, sf):
    return r.data_page_feed(i.records(spark, sf))


def _receipt(spark, sf):
    return r.receipt_feed(i.records(spark, sf))


def _form(spark, sf):
    return r.form_feed(i.records(spark, sf))


def _clone(spark, sf):
    cloned = r.clone_records(i.records(spark, sf), _all_ids(spark, sf), date(2026, 1, 2), "u1")
    return cloned.select("source_id", *_flat(cloned, "surname", "first_name", "issued", "receipt", "category", "issued_date", "receipt_date", "receipt_user"))


def _payer(spark, sf):
    """A third of the records still hold the payer filled in before, a third one
    typed by hand."""
    typed = F.when(F.col("id") % 3 == 0, "old payer").when(F.col("id") % 3 == 1, "by hand").otherwise("")
    records = i.records(spark, sf).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("Receipt.Received from"), typed)))
    filled = r.default_payer(records.withColumn("previous_payer", F.lit("old payer")))
    return filled.select("id", *_flat(filled, "payer"))


def _diff(spark, sf):
    return r.diff_records(i.records(spark, sf), i.record_changes(spark, sf))


def _unknown(spark, sf):
    return r.unknown_ids(i.record_changes(spark, sf), i.records(spark, sf)).select("id")


def _upsert(spark, sf):
    new, rejected = r.upsert_records(i.records(spark, sf), i.record_changes(spark, sf))
    kept = new.select("id", "created_at", *_flat(new, "surname", "issued"), F.lit(False).alias("rejected"))
    out = rejected.select("id", F.lit(None).cast("string").alias("created_at"), *_flat(rejected, "surname", "issued"), F.lit(True).alias("rejected"))
    return kept.unionByName(out)


def _neighbours(spark, sf):
    return r.neighbours(i.records(spark, sf))


def _first_last(spark, sf):
    return r.first_and_last(i.records(spark, sf))


def _numbered(spark, sf):
    records = i.records(spark, sf).select("id", r.field("Receipt.Number").alias("receipt"), r.field("Issued Document.Number").alias("issued"))
    receipts = r.assign_numbers(records, "receipt", start=700)
    return r.assign_numbers(receipts, "issued", start=1, prefix="IDL-")


def _ledger(spark, sf):
    """Receipt and issued numbers in two batches, and the first batch run again."""
    root = work_path(spark, "ledger")
    records = i.records(spark, sf).select("id", r.field("Receipt.Number").alias("receipt"), r.field("Issued Document.Number").alias("issued"))
    records = records.withColumn("typed", ~blank(trimmed("receipt")))

    def batch(name: str, rows: DataFrame) -> DataFrame:
        receipts = issue_numbers(rows, "receipt", f"{root}/receipts", name, registry=records)
        return reliable(issue_numbers(receipts, "issued", f"{root}/issued", name, prefix="IDL-", registry=records))

    first, second = records.where("id % 3 = 0"), records.where("id % 3 <> 0")
    one, two = batch("one", first), batch("two", second)
    again = batch("one", first).select("id", F.struct("receipt", "issued").alias("again"))
    rows = one.join(again, "id").withColumn("same_again", F.col("again") == F.struct("receipt", "issued")).drop("again")
    rows = rows.unionByName(two.withColumn("same_again", F.lit(True)))
    # typed receipts may repeat each other; a number that the counter gave is nobody else's
    often = rows.groupBy("receipt").agg(F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("typed")).alias("_given"))
    twice = F.when(F.col("typed"), F.col("_given")).otherwise(F.col("_all") - 1)
    return rows.join(often, "receipt").select("id", "receipt", "issued", "same_again", twice.alias("twice"))


def _change_log(spark, sf):
    """Line items as versions of their order's record."""
    items = i.table(spark, sf, "lineitem")
    version = (F.col("l_partkey") * 100000000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return items.select(
        F.col("l_orderkey").alias("id"), version.alias("version"),
        F.timestamp_seconds(F.col("l_partkey")).alias("ts"),
        F.create_map(F.lit("Surname"), F.concat(F.lit("S"), version)).alias("fields"),
    )


def _latest(spark, sf):
    latest = r.latest_records(_change_log(spark, sf))
    return latest.select("id", F.unix_timestamp("created_at").alias("created"), "version", *_flat(latest, "surname"))


def _insert(spark, sf):
    """Every customer as a new record after the last one."""
    base = i.records(spark, sf)
    new = i.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"), F.lit("2026-01-01T08:00:00").alias("created_at"),
        F.create_map(F.lit("Surname"), F.col("c_name")).alias("fields"),
    )
    grown = r.insert_records(base, new)
    return grown.select("id", "created_at", *_flat(grown, "surname"))


def _get(spark, sf):
    return r.get_records(i.records(spark, sf), _all_ids(spark, sf)).select("id", "created_at")


def _stored(spark, sf):
    """Written encrypted, read back."""
    path = work_path(spark, "records")
    write_records(i.records(spark, sf), path, key="0123456789abcdef")
    back = read_records(spark, path, key="0123456789abcdef")
    return back.select("id", "created_at", *_flat(back, "surname", "first_name", "issued", "receipt", "category"))


def _batch(spark, sf):
    """Every order as a change, every customer as a new record, and a second,
    later version of some changes."""
    orders = i.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    changes = orders.select(
        F.when(key % 101 == 0, key + 10000000).otherwise(key).alias("id"), F.lit(1).alias("version"), F.lit(None).cast("long").alias("seq"),
        F.create_map(
            F.lit("Surname"), F.when(key % 7 == 0, "").otherwise(F.col("o_orderpriority")),
            F.lit("Issued Document.Number"), F.when(key % 9 == 0, " ").otherwise("N1"),
        ).alias("fields"),
    )
    later = orders.where("o_orderkey % 5 = 0").select(
        F.when(key % 101 == 0, key + 10000000).otherwise(key).alias("id"), F.lit(2).alias("version"), F.lit(None).cast("long").alias("seq"),
        F.create_map(F.lit("Surname"), F.lit("LATER"), F.lit("Issued Document.Number"), F.lit("N2")).alias("fields"),
    )
    new = i.table(spark, sf, "customer").select(
        F.lit(None).cast("long").alias("id"), F.lit(1).alias("version"), F.col("c_custkey").alias("seq"),
        F.create_map(F.lit("Surname"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")), F.lit("Issued Document.Number"), F.lit("N3")).alias("fields"),
    )
    return changes.unionByName(later).unionByName(new)


def _save_batch(spark, sf):
    """All outputs: records, differences, rejects and audit lines."""
    saved = save_batch(i.records(spark, sf), _batch(spark, sf), "u1", "2026-01-02T08:00:00")
    row = lambda df, kind, *cols: df.select(F.lit(kind).alias("kind"), "id", *cols)
    text = lambda c, n: (F.col(c) if isinstance(c, str) else c).alias(n)
    none = F.lit("")
    return (
        row(saved.records, "record", text("created_at", "a"), text(r.field("Surname"), "b"), text(r.field("First Name"), "c"))
        .unionByName(row(saved.diffs, "diff", text("field", "a"), text("old", "b"), text("new", "c")))
        .unionByName(row(saved.rejects, "reject", text("reason", "a"), none.alias("b"), none.alias("c")))
        .unionByName(saved.lines.select(F.lit("line").alias("kind"), F.lit(None).cast("long").alias("id"), text("value", "a"), none.alias("b"), none.alias("c")))
    )


def _streamed(spark, sf):
    """The change log of line items, streamed in files, against orders as base."""
    root = work_path(spark, "registry")
    # ids ending in 3 are shifted, so that their changes meet no record
    shifted = F.when(F.col("id") % 10 == 3, F.col("id") + 10000000).otherwise(F.col("id"))
    i.records(spark, sf).withColumn("id", shifted).write.parquet(f"{root}/base")
    # two streams with a checkpoint each, then the log is folded into a new base
    for half in (0, 1):
        _change_log(spark, sf).where(F.col("id") % 2 == half).repartition(5, "id").write.parquet(f"{root}/in{half}")
        record_stream.stream_records(spark, f"{root}/in{half}", root, f"{root}/state{half}", files_per_batch=2).awaitTermination()
    record_stream.compact_records(spark, root, f"{root}/next")
    now = record_stream.current_records(spark, f"{root}/next")
    out = record_stream.rejected_changes(spark, f"{root}/next")
    return now.select("id", "created_at", *_flat(now, "surname"), F.lit(False).alias("rejected")).unionByName(
        out.select("id", F.lit(None).cast("string").alias("created_at"), *_flat(out, "surname"), F.lit(True).alias("rejected"))
    )


def _store(spark, sf, name: str, **options) -> RecordStore:
    """All records in a store of slices of 4096 ids."""
    store = RecordStore(spark, work_path(spark, name), slice_ids=4096, **options)
    store.create(i.records(spark, sf))
    return store


def _store_lookup(spark, sf):
    """Records of every order that has line items, by their slices, encrypted."""
    store = _store(spark, sf, "lookup", key="0123456789abcdef")
    found = store.lookup_all(_all_ids(spark, sf))
    return found.select("id", "created_at", *_flat(found, "surname", "first_name", "issued", "receipt", "category"))


def _store_upsert(spark, sf):
    """Changes applied to a store, and every customer added as a new record."""
    store = _store(spark, sf, "upsert")
    rejected = store.upsert(i.record_changes(spark, sf))
    top = store.manifest().agg(F.max("high").alias("top"))
    new = i.table(spark, sf, "customer").join(F.broadcast(top)).select(
        (F.col("top") + F.col("c_custkey")).alias("id"), F.lit("2026-01-01T08:00:00").alias("created_at"), F.create_map(F.lit("Surname"), F.col("c_name")).alias("fields")
    )
    store.insert(new)
    now = store.records()
    kept = now.select("id", "created_at", *_flat(now, "surname", "issued"), F.lit(False).alias("rejected"))
    out = rejected.select("id", F.lit(None).cast("string").alias("created_at"), *_flat(rejected, "surname", "issued"), F.lit(True).alias("rejected"))
    return kept.unionByName(out)


def _store_streamed(spark, sf):
    """The change log of line items by two streams into a store: some batches wait
    beside the base, others are merged."""
    root = work_path(spark, "stored_stream")
    shifted = F.when(F.col("id") % 10 == 3, F.col("id") + 10000000).otherwise(F.col("id"))
    log = reliable(_change_log(spark, sf))
    store = RecordStore(spark, f"{root}/store", slice_ids=4096, most_pending=log.count() // 3)
    store.create(i.records(spark, sf).withColumn("id", shifted))
    for half in (0, 1):
        log.where(F.col("id") % 2 == half).repartition(5, "id").write.parquet(f"{root}/in{half}")
        record_stream.stream_to_store(store, f"{root}/in{half}", f"{root}/state{half}", files_per_batch=2).awaitTermination()
    now, every = store.records(), store.rejected().select("id", "version")
    return now.select("id", "created_at", *_flat(now, "surname"), F.lit(False).alias("rejected")).unionByName(
        every.select("id", F.lit(None).cast("string").alias("created_at"), F.concat(F.lit("S"), F.col("version")).alias("surname"), F.lit(True).alias("rejected"))
    )


def _list_accounts(spark, sf):
    return accounts.list_accounts(i.accounts(spark, sf))


def _account_checks(spark, sf):
    return accounts.account_checks(i.accounts(spark, sf))


def _account_counts(spark, sf):
    return accounts.account_counts(i.accounts(spark, sf))


def _duplicate_names(spark, sf):
    return accounts.duplicate_names(i.accounts(spark, sf))


_v = lambda key: f"max(CASE WHEN k='{key}' THEN v END)"
_WIDE = f"""{i.RECORDS}, wide AS (SELECT id, created_at, {_v('Surname')} AS surname, {_v('First Name')} AS first_name,
  {_v('Issued Document.Number')} AS issued, {_v('Receipt.Number')} AS receipt, {_v('Original Document.Category')} AS category
  FROM record_kv JOIN created USING (id) GROUP BY id, created_at)"""
_REASON = "CASE WHEN trim(surname)='' THEN 'Surname is required' WHEN trim(issued)='' THEN 'Issued Document.Number is required' ELSE '' END"
_MARKS = ", ".join(f"CASE WHEN list_contains(list_transform(string_split(category,','), lambda x: trim(x)),'{c}') THEN 'X' ELSE '' END AS category_{c}" for c in r.CLASSES)
_FORM_OWN = {"surname": "surname", "first_name": "first_name", "orig_category": "category", "issued_number": "issued"}
_LIST = "SELECT id, split_part(created_at,'T',1) AS created, surname, first_name, '' AS original_document_number, issued AS issued_document_number FROM wide"
_QUOTED = "CASE WHEN {c}='' THEN '\"\"' WHEN regexp_matches({c}, '[\\s\"]') THEN '\"'||replace({c},'\"','\\\"')||'\"' ELSE {c} END"
_LOG = """change_log AS (SELECT l_orderkey AS id, (l_partkey*100000000+l_suppkey)*10+l_linenumber AS version, l_partkey AS ts FROM lineitem)"""

QUERIES = {
    "f3_search_records": (_search, f"""WITH {i.RECORDS} SELECT DISTINCT id FROM (SELECT id, v FROM record_kv UNION ALL SELECT id, CAST(id AS VARCHAR) FROM created
  UNION ALL SELECT id, created_at FROM created) WHERE lower(v) LIKE '%auto%'"""),
    "f3_indexed_search": (_indexed, f"""WITH {i.RECORDS}, needles AS (SELECT unnest([{", ".join(f"'{n}'" for n in _NEEDLES)}]) AS needle)
SELECT DISTINCT needle, id FROM (SELECT id, v FROM record_kv UNION ALL SELECT id, CAST(id AS VARCHAR) FROM created
  UNION ALL SELECT id, created_at FROM created), needles WHERE contains(lower(v), lower(trim(needle)))"""),
    "f4_list_view": (_list_view, f"WITH {_WIDE} {_LIST}"),
    "t1_newest_first": (_newest, f"WITH {_WIDE} {_LIST} ORDER BY id DESC"),
    "f5_validate_records": (_validate, f"WITH {_WIDE} SELECT id, {_REASON} AS reason FROM wide"),
    "f8_data_page_feed": (_data_page, f"""WITH {_WIDE} SELECT id, surname, first_name AS given_names, 'LEBANESE' AS nationality, '' AS date_of_birth,
  '' AS place_of_birth, issued AS permit_number, '' AS issue_date, {_MARKS} FROM wide"""),
    "f8_receipt_feed": (_receipt, f"WITH {_WIDE} SELECT id, receipt AS receipt_number, '' AS date, '' AS received_from, issued AS issued_no, '' AS amount FROM wide"),
    "f8_form_feed": (_form, f"WITH {_WIDE} SELECT id, " + ", ".join(f"{_FORM_OWN[c]} AS {c}" if c in _FORM_OWN else f"'' AS {c}" for c in dict.fromkeys(r.APPLICATION_FORM)) + " FROM wide"),
    "f9_clone_records": (_clone, f"""WITH {_WIDE} SELECT id AS source_id, surname, first_name, '' AS issued, '' AS receipt, category, '02/01/2026' AS issued_date,
  '' AS receipt_date, 'u1' AS receipt_user FROM wide WHERE id IN (SELECT l_orderkey FROM lineitem)"""),
    "f10_default_payer": (_payer, f"""WITH {_WIDE} SELECT id, CASE WHEN id%3=1 THEN 'by hand'
  ELSE concat_ws(' ', nullif(trim(first_name),''), nullif(trim(surname),'')) END AS payer FROM wide"""),
    "j8_diff_records": (_diff, f"""WITH {i.RECORD_KV}, {i.RECORD_CHANGES} SELECT c.id, c.k AS field, coalesce(b.v,'') AS old, c.v AS new
  FROM record_changes c JOIN (SELECT DISTINCT id FROM record_kv) x USING (id) LEFT JOIN record_kv b ON b.id=c.id AND b.k=c.k WHERE coalesce(b.v,'')<>c.v"""),
    "j9_unknown_ids": (_unknown, f"WITH {i.RECORD_KV}, {i.RECORD_CHANGES} SELECT id FROM record_changes ANTI JOIN record_kv USING (id)"),
    "k1_upsert_records": (_upsert, f"""WITH {_WIDE}, {i.RECORD_CHANGES} SELECT w.id, created_at, CASE WHEN c.id IS NULL THEN surname ELSE c.v END AS surname,
  CASE WHEN c.id IS NULL THEN issued END AS issued, FALSE AS rejected FROM wide w LEFT JOIN record_changes c ON w.id=c.id
UNION ALL SELECT id, NULL, v, NULL, TRUE FROM record_changes ANTI JOIN wide USING (id)"""),
    "w7_neighbours": (_neighbours, "SELECT o_orderkey AS id, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS previous_id, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS next_id FROM orders SEMI JOIN customer ON o_custkey=c_custkey"),
    "w7_first_and_last": (_first_last, "SELECT max(o_orderkey) AS previous_id, min(o_orderkey) AS next_id FROM orders SEMI JOIN customer ON o_custkey=c_custkey"),
    "w8_assign_numbers": (_numbered, f"""WITH {_WIDE}, n AS (SELECT *, row_number() OVER (PARTITION BY receipt='' ORDER BY id) AS rn, row_number() OVER (PARTITION BY issued='' ORDER BY id) AS iss FROM wide)
SELECT id, CASE WHEN receipt='' THEN printf('%06d', greatest(699, (SELECT max(try_cast(receipt AS BIGINT)) FROM wide))+rn) ELSE receipt END AS receipt,
  CASE WHEN issued='' THEN printf('IDL-%06d', iss) ELSE issued END AS issued FROM n"""),
    "w8_number_ledger": (_ledger, f"""WITH {_WIDE}, n AS (SELECT *, row_number() OVER (PARTITION BY receipt='' ORDER BY CASE WHEN id%3=0 THEN 0 ELSE 1 END, id) AS rn,
  row_number() OVER (PARTITION BY issued='' ORDER BY CASE WHEN id%3=0 THEN 0 ELSE 1 END, id) AS iss FROM wide)
SELECT id, CASE WHEN receipt='' THEN printf('%06d', (SELECT max(try_cast(receipt AS BIGINT)) FROM wide)+rn) ELSE receipt END AS receipt,
  CASE WHEN issued='' THEN printf('IDL-%06d', iss) ELSE issued END AS issued, TRUE AS same_again, 0 AS twice FROM n"""),
    "w9_latest_records": (_latest, f"""WITH {_LOG} SELECT id, arg_min(ts, version) AS created, max(version) AS version, 'S'||CAST(max(version) AS VARCHAR) AS surname FROM change_log GROUP BY id"""),
    "k1_insert_records": (_insert, f"""WITH {_WIDE} SELECT id, created_at, surname FROM wide
UNION ALL SELECT (SELECT max(id) FROM wide)+row_number() OVER (ORDER BY c_custkey), '2026-01-01T08:00:00', c_name FROM customer"""),
    "t5_get_records": (_get, f"WITH {i.CREATED} SELECT id, created_at FROM created WHERE id IN (SELECT l_orderkey FROM lineitem)"),
    "s4_stored_records": (_stored, f"WITH {_WIDE} SELECT id, created_at, surname, first_name, issued, receipt, category FROM wide"),
    "p6_save_batch": (_save_batch, f"""WITH {_WIDE}, raw AS (SELECT CASE WHEN o_orderkey%101=0 THEN o_orderkey+10000000 ELSE o_orderkey END AS id,
  CASE WHEN o_orderkey%5=0 THEN 'LATER' WHEN o_orderkey%7=0 THEN '' ELSE o_orderpriority END AS s,
  CASE WHEN o_orderkey%5=0 THEN 'N2' WHEN o_orderkey%9=0 THEN ' ' ELSE 'N1' END AS n FROM orders),
good AS (SELECT * FROM raw WHERE s<>'' AND trim(n)<>''),
fresh AS (SELECT (SELECT max(id) FROM wide)+row_number() OVER (ORDER BY c_custkey) AS id, c_name AS s FROM customer WHERE c_custkey%7<>0),
diffs AS (SELECT id, 'Surname' AS field, surname AS old, s AS new FROM good JOIN wide USING (id) WHERE surname<>s
  UNION ALL SELECT id, 'Issued Document.Number', issued, n FROM good JOIN wide USING (id) WHERE issued<>n),
saves AS (SELECT id, 'update' AS mode FROM good SEMI JOIN wide USING (id) UNION ALL SELECT id, 'insert' FROM fresh),
head AS (SELECT id, '2026-01-02 08:00:00 event=record_saved user=u1 record_id='||id||' mode='||mode||' changed_field_count='||(SELECT count(*) FROM diffs d WHERE d.id=s.id) AS line FROM saves s)
SELECT 'record' AS kind, w.id, created_at AS a, CASE WHEN g.id IS NULL THEN surname ELSE g.s END AS b, CASE WHEN g.id IS NULL THEN first_name ELSE '' END AS c
  FROM wide w LEFT JOIN good g ON w.id=g.id
UNION ALL SELECT 'record', id, '2026-01-02T08:00:00', s, '' FROM fresh
UNION ALL SELECT 'diff', id, field, old, new FROM diffs
UNION ALL SELECT 'reject', id, CASE WHEN s='' THEN 'Surname is required' ELSE 'Issued Document.Number is required' END, '', '' FROM raw WHERE s='' OR trim(n)=''
UNION ALL SELECT 'reject', NULL, 'Surname is required', '', '' FROM customer WHERE c_custkey%7=0
UNION ALL SELECT 'reject', id, 'unknown id', '', '' FROM good ANTI JOIN wide USING (id)
UNION ALL SELECT 'line', NULL, line, '', '' FROM head
UNION ALL SELECT 'line', NULL, '2026-01-02 08:00:00 event=field_corrected user=u1 record_id='||id||' field='||{_QUOTED.format(c='field')}||' old='||{_QUOTED.format(c='old')}||' new='||{_QUOTED.format(c='new')}, '', '' FROM diffs"""),
    "t5_store_lookup": (_store_lookup, f"WITH {_WIDE} SELECT id, created_at, surname, first_name, issued, receipt, category FROM wide WHERE id IN (SELECT l_orderkey FROM lineitem)"),
    "k1_store_upsert": (_store_upsert, f"""WITH {_WIDE}, {i.RECORD_CHANGES} SELECT w.id, created_at, CASE WHEN c.id IS NULL THEN surname ELSE c.v END AS surname,
  CASE WHEN c.id IS NULL THEN issued END AS issued, FALSE AS rejected FROM wide w LEFT JOIN record_changes c ON w.id=c.id
UNION ALL SELECT id, NULL, v, NULL, TRUE FROM record_changes ANTI JOIN wide USING (id)
UNION ALL SELECT (SELECT max(id) FROM wide)+c_custkey, '2026-01-01T08:00:00', c_name, NULL, FALSE FROM customer"""),
    "x2_store_stream": (_store_streamed, f"""WITH {_WIDE}, {_LOG}, base AS (SELECT * REPLACE (CASE WHEN id%10=3 THEN id+10000000 ELSE id END AS id) FROM wide),
latest AS (SELECT id, max(version) AS version FROM change_log GROUP BY id)
SELECT b.id, created_at, CASE WHEN version IS NULL THEN surname ELSE 'S'||CAST(version AS VARCHAR) END AS surname, FALSE AS rejected FROM base b LEFT JOIN latest USING (id)
UNION ALL SELECT id, NULL, 'S'||CAST(version AS VARCHAR), TRUE FROM change_log ANTI JOIN base USING (id)"""),
    "x2_stream_records": (_streamed, f"""WITH {_WIDE}, {_LOG}, base AS (SELECT * REPLACE (CASE WHEN id%10=3 THEN id+10000000 ELSE id END AS id) FROM wide),
latest AS (SELECT id, max(version) AS version FROM change_log GROUP BY id)
SELECT b.id, created_at, CASE WHEN version IS NULL THEN surname ELSE 'S'||CAST(version AS VARCHAR) END AS surname, FALSE AS rejected FROM base b LEFT JOIN latest USING (id)
UNION ALL SELECT id, NULL, 'S'||CAST(version AS VARCHAR), TRUE FROM change_log ANTI JOIN base USING (id)"""),
    "t2_list_accounts": (_list_accounts, f"WITH {i.ACCOUNTS} SELECT * FROM accounts ORDER BY lower(username), username"),
    "a9_account_checks": (_account_checks, f"""WITH {i.ACCOUNTS}, names AS (SELECT lower(trim(username)) AS name, count(*) AS n, count(*) FILTER (is_admin) AS na FROM accounts GROUP BY 1)
SELECT name, n, n > 1 AS duplicate, na > 0 AS is_admin, na > 0 AND (SELECT sum(na) FROM names) <= 1 AS last_admin FROM names"""),
    "a9_account_counts": (_account_counts, f"WITH {i.ACCOUNTS} SELECT count(*) AS users, count(*) FILTER (is_admin) AS admins, count(*) FILTER (is_admin) <= 1 AS last_admin FROM accounts"),
    "a9_duplicate_names": (_duplicate_names, f"WITH {i.ACCOUNTS} SELECT lower(trim(username)) AS name, count(*) AS n FROM accounts GROUP BY 1 HAVING count(*) > 1"),
}

"""The record registry: id, created_at and a map of text fields per record."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreg.common import blank, text_or_blank, trimmed

#: Ids per slice. Slices are sliced again, until one slice holds all ids there can be.
ID_SLICE = 1 << 20
_ID_RANGE = 1 << 64

LISTED = ["Surname", "First Name", "Original Document.Number", "Issued Document.Number"]
REQUIRED = {"Surname": "Surname is required", "Issued Document.Number": "Issued Document.Number is required"}
# Nationality on the data page, and its classes.
NATIONALITY = "LEBANESE"
CLASSES = ["A", "B", "C", "D", "E"]


def field(key: str, fields: str = "fields") -> Column:
    """A field of the record map; absent → blank."""
    return F.coalesce(F.try_element_at(F.col(fields), F.lit(key)), F.lit(""))


def _with(overrides: dict[str, Column], fields: str = "fields") -> Column:
    """The map with some keys replaced or added."""
    names = list(overrides)
    kept = F.map_filter(F.col(fields), lambda k, v: ~k.isin(names))
    return F.map_concat(kept, F.create_map(*[x for n in names for x in (F.lit(n), overrides[n])]))


def created_text(records: DataFrame) -> Column:
    """Time of creation in ISO form, from a text or a time stamp column."""
    kind = records.schema["created_at"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return F.col("created_at").cast("string")


def search_records(records: DataFrame, needle: str) -> DataFrame:
    """Records whose id, time of creation or any field value holds the text,
    without regard to case. A blank text matches all."""
    needle = needle.strip().lower()
    if not needle:
        return records
    values = F.concat(F.map_values("fields"), F.array(F.col("id").cast("string"), created_text(records)))
    return records.filter(F.exists(values, lambda v: F.contains(F.lower(F.coalesce(v, F.lit(""))), F.lit(needle))))


def list_view(records: DataFrame, newest_first: bool = False) -> DataFrame:
    """The listing: id, day of creation and four fields."""
    day = F.split(created_text(records), "T")[0]
    names = [k.lower().replace(" ", "_").replace(".", "_") for k in LISTED]
    view = records.select("id", day.alias("created"), *[field(k).alias(n) for k, n in zip(LISTED, names)])
    return view.orderBy(F.desc("id")) if newest_first else view


def get_records(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id"), "id", "left_semi")


def _reason() -> Column:
    return F.coalesce(*[F.when(blank(trimmed(field(k))), F.lit(why)) for k, why in REQUIRED.items()])


def validate_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a record needs a surname and an issued number. The
    rejected ones carry the first reason."""
    checked = records.withColumn("reason", _reason())
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def clone_records(records: DataFrame, ids: DataFrame, run_date: date, user: str) -> DataFrame:
    """New records, without an id, prefilled from earlier ones."""
    fresh = {
        "Issued Document.Number": F.lit(""),
        "Issued Document.Date": F.lit(run_date.strftime("%d/%m/%Y")),
        "Receipt.Date": F.lit(""),
        "Receipt.Number": F.lit(""),
        "Receipt.User": F.lit(user),
    }
    return get_records(records, ids).select(F.col("id").alias("source_id"), _with(fresh).alias("fields"))


def default_payer(records: DataFrame, previous: str = "previous_payer") -> DataFrame:
    """Fill the payer with first name and surname where it is blank or still
    what was filled in before (column ``previous``)."""
    parts = [F.nullif(trimmed(field(k)), F.lit("")) for k in ("First Name", "Surname")]
    payer = field("Receipt.Received from")
    untouched = (payer == "") | (payer == F.coalesce(F.col(previous), F.lit("")))
    computed = F.when(untouched, F.concat_ws(" ", *parts)).otherwise(payer)
    return records.withColumn("fields", _with({"Receipt.Received from": computed}))


def data_page_feed(records: DataFrame) -> DataFrame:
    """Values of the booklet's data page, with a mark per class held."""
    held = F.transform(F.split(field("Original Document.Category"), ","), trimmed)
    return records.select(
        "id",
        field("Surname").alias("surname"),
        field("First Name").alias("given_names"),
        F.lit(NATIONALITY).alias("nationality"),
        field("Date of B.").alias("date_of_birth"),
        field("Place of B.").alias("place_of_birth"),
        field("Issued Document.Number").alias("permit_number"),
        field("Issued Document.Date").alias("issue_date"),
        *[F.when(F.array_contains(held, c), "X").otherwise("").alias(f"category_{c}") for c in CLASSES],
    )


# Columns of the receipt and the application form, by field.
RECEIPT = {
    "receipt_number": "Receipt.Number", "date": "Receipt.Date", "received_from": "Receipt.Received from",
    "issued_no": "Issued Document.Number", "amount": "Receipt.Amount(LBP)",
}
APPLICATION_FORM = {
    "surname": "Surname", "first_name": "First Name", "father_name": "Father's Name",
    "mother_name": "Mother's Name", "place_of_birth": "Place of B.", "date_of_birth": "Date of B.",
    "address": "Address", "phone": "Phone", "email": "Email", "blood_type": "Blood Type",
    "orig_number": "Original Document.Number", "orig_date": "Original Document.Date",
    "orig_place_of_issue": "Original Document.Place of Issue", "orig_category": "Original Document.Category",
    "orig_expiry_date": "Original Document.Expiry Date", "issued_number": "Issued Document.Number",
    "issued_date": "Issued Document.Date",
}


def _feed(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    return records.select("id", *[field(k).alias(name) for name, k in columns.items()])


def receipt_feed(records: DataFrame) -> DataFrame:
    return _feed(records, RECEIPT)


def form_feed(records: DataFrame) -> DataFrame:
    return _feed(records, APPLICATION_FORM)


def diff_records(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """One row per field whose value differs from the baseline record; a key the
    baseline lacks counts as blank. Records without a baseline give no rows.

    One join by id; the two maps meet inside the row."""
    both = new.select("id", F.col("fields").alias("_new")).join(
        baseline.select("id", F.col("fields").alias("_old")), "id"
    )
    pairs = F.transform(
        F.map_entries("_new"),
        lambda e: F.struct(
            e["key"].alias("field"),
            F.coalesce(F.try_element_at(F.col("_old"), e["key"]), F.lit("")).alias("old"),
            F.coalesce(e["value"], F.lit("")).alias("new"),
        ),
    )
    return both.select("id", F.inline(F.filter(pairs, lambda p: p["old"] != p["new"])))


def unknown_ids(changes: DataFrame, base: DataFrame) -> DataFrame:
    return changes.join(base.select("id"), "id", "left_anti")


def _plain(df: DataFrame, name: str) -> Column:
    """A column in a form that can be ordered: a map as its sorted entries."""
    return F.array_sort(F.map_entries(name)) if isinstance(df.schema[name].dataType, T.MapType) else F.col(name)


def one_per_id(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled, repeated): of several changes to one id the last ``version``
    counts, of equal versions the one with the greatest values, so a rerun settles
    alike. Without versions there is no telling which is meant: such changes are
    returned as repeated. Changes without id are new records and pass."""
    plain = changes.where(F.col("id").isNull())
    named = changes.where(F.col("id").isNotNull())
    if "version" in changes.columns:
        rest = [c for c in changes.columns if c != "id"]
        order = F.struct("version", *[_plain(changes, c).alias(c) for c in rest if c != "version"])
        last = named.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_last"))
        return last.select("id", "_last.*").select(*changes.columns).unionByName(plain), named.limit(0)
    often = named.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("id")
    return named.join(often, "id", "left_anti").select(*changes.columns).unionByName(plain), named.join(often, "id", "left_semi").select(*changes.columns)


def upsert_records(base: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new base, rejected): a change replaces the whole map of its record and
    leaves ``created_at``. Changes to unknown ids are returned, not applied, and so
    are repeated changes to one id that no ``version`` settles."""
    changes, repeated = one_per_id(changes)
    update = changes.select("id", F.struct("fields").alias("_change"))
    new = base.join(update, "id", "left").withColumn(
        "fields", F.when(F.col("_change").isNotNull(), F.col("_change.fields")).otherwise(F.col("fields"))
    )
    return new.select(*base.columns), unknown_ids(changes, base).unionByName(repeated)


def latest_records(changes: DataFrame) -> DataFrame:
    """Current state from an append-only log (id, version, ts, fields): fields of
    the last version, time of the first. Of equal versions the later counts as the
    last, then the one with the greater fields, and the earlier as the first.
    Aggregated, so an id with very many versions is reduced before any row moves."""
    return changes.groupBy("id").agg(
        F.min(F.struct("version", "ts"))["ts"].alias("created_at"),
        F.max("version").alias("version"),
        F.max_by("fields", F.struct("version", "ts", _plain(changes, "fields").alias("fields"))).alias("fields"),
    )


def _levels(id_slice: int) -> int:
    """How often ids are sliced until one slice holds all there can be."""
    levels, span = 0, _ID_RANGE
    while span > id_slice:
        levels, span = levels + 1, -(-span // id_slice)
    return levels


def _beside(rows: DataFrame, id_slice: int, levels: int) -> DataFrame:
    """Rows (_at, _head, _tail) with the tail before and the head after each in
    order of ``_at``. Rows meet inside their slice; the ends of slices meet the
    same way one level up, so no window holds more rows than a slice has ids."""
    look = lambda order: (F.lag("_tail").over(order).alias("_before"), F.lead("_head").over(order).alias("_after"))
    if levels == 0:
        return rows.select("_at", *look(Window.orderBy("_at")))
    sliced = rows.withColumn("_slice", F.floor(F.col("_at") / id_slice))
    ends = sliced.groupBy("_slice").agg(F.min_by("_head", "_at").alias("_head"), F.max_by("_tail", "_at").alias("_tail"))
    above = _beside(ends.withColumnRenamed("_slice", "_at"), id_slice, levels - 1)
    above = above.select(F.col("_at").alias("_slice"), F.col("_before").alias("_far_before"), F.col("_after").alias("_far_after"))
    inside = sliced.select("_at", "_slice", *look(Window.partitionBy("_slice").orderBy("_at")))
    return inside.join(above, "_slice").select(
        "_at", F.coalesce("_before", "_far_before").alias("_before"), F.coalesce("_after", "_far_after").alias("_after")
    )


def neighbours(records: DataFrame, id_slice: int = ID_SLICE) -> DataFrame:
    """Previous and next id of every record; NULL at the ends."""
    rows = records.select(F.col("id").alias("_at"), F.col("id").alias("_head"), F.col("id").alias("_tail"))
    found = _beside(rows, id_slice, _levels(id_slice))
    return found.select(F.col("_at").alias("id"), F.col("_before").alias("previous_id"), F.col("_after").alias("next_id"))


def first_and_last(records: DataFrame) -> DataFrame:
    """Where browsing starts without a current record: next → first, previous → last."""
    return records.agg(F.max("id").alias("previous_id"), F.min("id").alias("next_id"))


def _ahead(counts: DataFrame, id_slice: int, levels: int) -> DataFrame:
    """Rows (_slice, _n) with the sum of ``_n`` of all earlier slices, level by
    level as in ``_beside``."""
    before = lambda order: F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if levels <= 0:
        return counts.select("_slice", before(Window.orderBy("_slice")).alias("_ahead"))
    sliced = counts.withColumn("_outer", F.floor(F.col("_slice") / id_slice))
    above = _ahead(sliced.groupBy(F.col("_outer").alias("_slice")).agg(F.sum("_n").alias("_n")), id_slice, levels - 1)
    above = above.select(F.col("_slice").alias("_outer"), F.col("_ahead").alias("_far"))
    inside = sliced.select("_slice", "_outer", before(Window.partitionBy("_outer").orderBy("_slice")).alias("_near"))
    return inside.join(above, "_outer").select("_slice", (F.col("_near") + F.col("_far")).alias("_ahead"))


def _running_number(rows: DataFrame, order: str, id_slice: int) -> DataFrame:
    """``_number`` from 1 by ``order``: counted per slice, then shifted by the
    sizes of the earlier slices."""
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / id_slice))
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _ahead(counts, id_slice, _levels(id_slice) - 1)
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    return (
        sliced.withColumn("_rank", rank).join(offsets, "_slice")
        .withColumn("_number", F.col("_ahead") + F.col("_rank"))
        .drop("_slice", "_rank", "_ahead")
    )


def number_text(serial: Column, prefix: str = "") -> Column:
    """A number as it is printed: prefix and six digits, more if it needs more."""
    digits = F.when(serial < 1_000_000, F.lpad(serial.cast("string"), 6, "0")).otherwise(serial.cast("string"))
    return F.concat(F.lit(prefix), digits)


def number_of(c: Column | str, prefix: str = "") -> Column:
    """The number in a text of prefix and digits; NULL in any other text."""
    return F.regexp_extract(trimmed(text_or_blank(c)), rf"^{re.escape(prefix)}(\d{{1,18}})$", 1).try_cast("long")


def assign_numbers(
    records: DataFrame, column: str, start: int = 1, prefix: str = "", order: str = "id", id_slice: int = ID_SLICE
) -> DataFrame:
    """Give every row whose ``column`` is blank the next number of a sequence,
    as prefix and six digits; numbered rows keep theirs. The sequence begins at
    ``start``, or behind the highest number in use if that is more, so none is given
    twice. ``number_ledger.issue_numbers`` also remembers numbers between batches."""
    to_number = blank(trimmed(text_or_blank(column)))
    numbered = _running_number(records.filter(to_number), order, id_slice)
    used = records.agg(F.coalesce(F.max(number_of(column, prefix)), F.lit(0)).alias("_used"))
    serial = F.col("_number") + F.greatest(F.lit(start - 1), F.col("_used"))
    fresh = numbered.join(F.broadcast(used)).withColumn(column, number_text(serial, prefix)).select(*records.columns)
    return records.filter(~to_number).unionByName(fresh)


def new_records(base: DataFrame, new: DataFrame, order: str = "seq", id_slice: int = ID_SLICE) -> DataFrame:
    """New records (``order``, ``created_at``, ``fields``) numbered on from the
    highest id."""
    numbered = _running_number(new, order, id_slice)
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = numbered.join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_number"))
    return rows.select(*base.columns)


def insert_records(base: DataFrame, new: DataFrame, order: str = "seq", id_slice: int = ID_SLICE) -> DataFrame:
    """The base with new records added, see ``new_records``."""
    return base.unionByName(new_records(base, new, order, id_slice))

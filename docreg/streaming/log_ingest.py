"""Live and rotated audit logs into an event table, each line once.

A log is a file that grows and, when full, is renamed: ``audit.log`` becomes
``audit.log.1``, that ``audit.log.2`` and so on, and the oldest goes. A source of
files reads a path once, so it would lose lines that are added later and repeat
those of a renamed file. Here a table of offsets is kept beside the events: for each
file its length and time, how many bytes were taken, and the digest of these bytes.

A run lists all files. Those of known length and time are left alone, whatever their
name is by now. Of the others, one that begins with the bytes once taken from a file
that is no longer there in its old form is that file, grown or renamed: it is read on
from there. The rest are new and read from their first byte. A last line without its
end waits for the next run, and so does a last event whose quotes are still open.

New bytes are written first, events and offsets are derived from what was written,
and the offsets are the commit: a run that was killed is repeated whole, and nothing
is counted twice. Contents are read by file, so a log must be rotated below 2 GB. A
run without news costs a listing; the paths of changed files pass the driver, as
Spark's own listing does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docreg.common import reliable
from docreg.sources.audit_log import STAMP, parse_audit
from docreg.sources.commits import commit, last_version, version_path

OFFSETS = "log string, seq long, length long, modified timestamp, taken long, digest string"
_BYTES = "ISO-8859-1"  # one character a byte


def _listed(spark: SparkSession, src: str) -> DataFrame:
    """(path, log, age, length, modified) of the files; age 0 is the live one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(src)
    age = F.coalesce(F.nullif(F.regexp_extract("path", r"\.(\d+)$", 1), F.lit("")).cast("long"), F.lit(0))
    return files.select("path", F.regexp_replace("path", r"\.\d+$", "").alias("log"), age.alias("age"), "length", F.col("modificationTime").alias("modified"))


def _offsets(spark: SparkSession, dst: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], OFFSETS)
    return spark.read.schema(OFFSETS).parquet(version_path(f"{dst}/offsets", version))


def _known(listed: DataFrame, offsets: DataFrame) -> DataFrame:
    """Files that are as they were, with their offsets. Where files are alike in
    length and time, the older file is the older row."""
    alike = ["log", "length", "modified"]
    files = listed.withColumn("_place", F.row_number().over(Window.partitionBy(*alike).orderBy(F.desc("age"))))
    rows = offsets.withColumn("_place", F.row_number().over(Window.partitionBy(*alike).orderBy("seq")))
    return files.join(rows, [*alike, "_place"]).select("path", *offsets.columns)


def _begun(contents: DataFrame, missing: DataFrame) -> DataFrame:
    """(path, seq, taken) of the files that go on where an earlier run ended."""
    same = F.octet_length("content") >= F.col("taken")
    same &= F.sha2(F.substring(F.col("content"), F.lit(1), F.col("taken").cast("int")), 256) == F.col("digest")
    fits = contents.join(missing.where("taken > 0"), "log").where(same).select("path", "log", "age", "seq", "taken")
    longest = fits.groupBy("path", "log", "age").agg(F.max(F.struct("taken", "seq")).alias("_own"))
    oldest = Window.partitionBy("log", "_own").orderBy(F.desc("age"))
    return longest.withColumn("_place", F.row_number().over(oldest)).where("_place = 1").select("path", "_own.seq", "_own.taken")


def _fresh(contents: DataFrame) -> DataFrame:
    """The events of each file's new bytes, and how many bytes they take."""
    text = F.decode(F.substring(F.col("content"), F.col("taken").cast("int") + 1, F.octet_length("content")), _BYTES)
    ended = contents.withColumn("_text", text).withColumn("_text", F.substring(F.col("_text"), F.lit(1), F.length("_text") - F.instr(F.reverse("_text"), "\n") + 1))
    ended = ended.withColumn("_text", F.when(F.endswith("_text", F.lit("\n")), F.col("_text")).otherwise(""))
    events = ended.withColumn("_events", F.when(F.col("_text") != "", F.split("_text", rf"(?<=\n)(?={STAMP})")).otherwise(F.array().cast("array<string>")))
    last = F.coalesce(F.try_element_at("_events", F.lit(-1)), F.lit(""))
    bare = F.regexp_replace(last, r"(?s)\\.", "")
    open_ = (F.col("age") == 0) & (F.regexp_count(bare, F.lit('"')) % 2 == 1)
    kept = events.withColumn("_wait", F.when(open_, F.length(last)).otherwise(0)).withColumn("_events", F.when(open_, F.slice("_events", F.lit(1), F.size("_events") - 1)).otherwise(F.col("_events")))
    end = (F.col("taken") + F.length("_text") - F.col("_wait")).alias("end")
    whole = F.transform("_events", lambda e: F.encode(F.regexp_replace(e, r"\r?\n$", ""), _BYTES).cast("string"))
    digest = F.sha2(F.substring(F.col("content"), F.lit(1), end.cast("int")), 256).alias("digest")
    return kept.select("path", "log", "seq", "age", "modified", F.octet_length("content").cast("long").alias("length"), end, digest, whole.alias("events"))


def ingest_logs(spark: SparkSession, src: str, dst: str) -> int | None:
    """Take what is new in the logs below ``src`` into ``dst``. Returns the last
    committed run, which is a new one only if there was news."""
    last = last_version(spark, f"{dst}/offsets")
    offsets = _offsets(spark, dst, last)
    listed = reliable(_listed(spark, src))
    known = reliable(_known(listed, offsets))
    changed = reliable(listed.join(known.select("path"), "path", "left_anti"))
    paths = [row.path for row in changed.select("path").toLocalIterator()]
    if not paths:
        return last
    run = 0 if last is None else last + 1
    missing = offsets.join(known.select("log", "seq"), ["log", "seq"], "left_anti")
    contents = spark.read.format("binaryFile").load(paths).select("path", "content").join(changed, "path")
    contents = reliable(contents.select("path", "content", "log", "age", "modified"))
    goes_on = reliable(_begun(contents, missing))
    begun = contents.join(goes_on, "path", "left")
    # new files follow in the order of their age
    top = offsets.groupBy("log").agg(F.max("seq").alias("_top"))
    new = changed.join(goes_on.select("path"), "path", "left_anti").select("path", "log", "age")
    numbers = new.join(top, "log", "left").select(
        "path", (F.coalesce("_top", F.lit(-1)) + F.row_number().over(Window.partitionBy("log").orderBy(F.desc("age")))).alias("_seq")
    )
    begun = begun.join(numbers, "path", "left").withColumn("seq", F.coalesce("seq", "_seq")).withColumn("taken", F.coalesce("taken", F.lit(0)))
    fresh = reliable(_fresh(begun))
    lines = fresh.select("log", "seq", F.posexplode("events").alias("line_no", "value"))
    parse_audit(lines, keep=["log", "seq", "line_no"]).write.mode("overwrite").parquet(version_path(f"{dst}/events", run))
    taken = fresh.select("log", "seq", "length", "modified", F.col("end").alias("taken"), "digest")
    commit(known.select(*taken.columns).unionByName(taken), f"{dst}/offsets", run)
    return run


def ingested_events(spark: SparkSession, dst: str) -> DataFrame:
    """The events of all committed runs: (version, log, seq, line_no, ts, ...). Within
    a log, version, seq and line_no are the order of the lines."""
    last = last_version(spark, f"{dst}/offsets")
    if last is None:
        raise FileNotFoundError(f"no committed run below {dst}")
    return spark.read.parquet(f"{dst}/events").where(F.col("version") <= last)

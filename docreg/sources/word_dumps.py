"""Word-dump files: JSON arrays of words per page region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = "array<struct<text: string, confidence: double, box: array<int>>>"
_LINE = f"struct<region: string, words: {_WORDS}>"
_PLAIN = r"([^/]+)/([^/]+)_words\.json$"
_RUN = r"run=([^/]+)/[^/]+$"
MALFORMED = "malformed words"


def _files(spark: SparkSession, path: str, names: str, whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    return reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"))


def _dumps(spark: SparkSession, path: str) -> DataFrame:
    """(run, region, value, words): every region of a folder; ``words`` is NULL
    where the text is no array of words. Run and region come from
    ``<run>/<region>_words.json``, or from the folder and the line that
    ``write_word_dumps`` writes."""
    # a path is percent-encoded once, the name of a partition folder once more
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    plain = _files(spark, path, "*_words.json", True).select(
        decoded(F.regexp_extract("file", _PLAIN, 1)).alias("run"), decoded(F.regexp_extract("file", _PLAIN, 2)).alias("region"),
        "value", F.from_json("value", _WORDS).alias("words"),
    )
    line = F.from_json("value", _LINE)
    written = _files(spark, path, "part-*", False).select(
        decoded(decoded(F.regexp_extract("file", _RUN, 1))).alias("run"), line["region"].alias("region"), "value", line["words"].alias("words")
    )
    return plain.unionByName(written)


def _good() -> Column:
    """An array in which every word has a text and four corners."""
    complete = lambda w: w.isNotNull() & w["text"].isNotNull() & w["confidence"].isNotNull() & (F.coalesce(F.size(w["box"]), F.lit(0)) == 4)
    return F.col("words").isNotNull() & F.forall("words", lambda w: F.coalesce(complete(w), F.lit(False)))


def read_word_dumps(spark: SparkSession, path: str) -> DataFrame:
    """The words table of a folder of dumps; ``word_no`` is the place in the
    array. A region that cannot be read has its row in ``bad_word_dumps``."""
    words = _dumps(spark, path).where(_good()).select("run", "region", F.posexplode("words").alias("word_no", "w"))
    box = {name: F.col("w.box")[i].alias(name) for i, name in enumerate(["x0", "y0", "x1", "y1"])}
    return words.select("run", "region", "word_no", F.col("w.text").alias("text"), F.col("w.confidence").alias("conf"), *box.values())


def bad_word_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(run, region, value, error) of every region whose words cannot be read."""
    return _dumps(spark, path).where(~F.coalesce(_good(), F.lit(False))).select("run", "region", "value", F.lit(MALFORMED).alias("error"))


def dump_payloads(words: DataFrame) -> DataFrame:
    """(run, region, value): the JSON array of each region's words, confidences
    to three places. A region without words has no row."""
    listed = _listed(words)
    return listed.select("run", "region", F.to_json("words").alias("value"))


def _listed(words: DataFrame) -> DataFrame:
    # flat while it is shuffled, nested afterwards
    flat = F.struct("word_no", "text", F.round("conf", 3).alias("conf"), "x0", "y0", "x1", "y1")
    item = lambda w: F.struct(w["text"].alias("text"), w["conf"].alias("confidence"), F.array(*[w[c] for c in ("x0", "y0", "x1", "y1")]).alias("box"))
    listed = words.groupBy("run", "region").agg(F.array_sort(F.collect_list(flat)).alias("_flat"))
    # a region may be named by a number; printed only here, so that pages dealt out by it stay where they are
    return listed.select("run", F.col("region").cast("string").alias("region"), F.transform("_flat", item).alias("words"))


def write_word_dumps(words: DataFrame, path: str) -> None:
    """One folder per run, one line per region, in files packed by gzip: their number
    follows the number of tasks, not of pages."""
    line = F.to_json(F.struct("region", "words"))
    packed = _listed(words).select("run", line.alias("value")).write.partitionBy("run").mode("append")
    packed.option("compression", "gzip").text(path)

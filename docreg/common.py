"""Small helpers shared by every module."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a word table beside its page key.
WORD_COLUMNS = ["word_no", "text", "conf", "x0", "y0", "x1", "y1"]

#: Confidences are summed as decimals that keep every digit a double prints, so a
#: mean does not depend on the order in which partial sums arrive.
CONF_DIGITS = "decimal(28,20)"
CONF_SUM = "decimal(38,20)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """True for NULL and for the empty string: both mean "no value"."""
    return F.coalesce(col(c), F.lit("")) == ""


def text_or_blank(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def trimmed(c: Column | str) -> Column:
    """Trim all white space at both ends, not only spaces."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def conf_sum(c: Column | str = "conf") -> Column:
    """Aggregate: exact sum of confidences."""
    return F.sum(col(c).cast(CONF_DIGITS))


def mean_of_sum(total: Column, n: Column) -> Column:
    """Mean confidence from an exact sum; 0.0 for an empty group."""
    return F.coalesce(F.when(n > 0, total.cast("double") / n), F.lit(0.0))


def mean_conf(c: Column | str = "conf") -> Column:
    """Aggregate: mean confidence of a group."""
    return mean_of_sum(conf_sum(c), F.count(col(c)))


def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that are worked out once. Columns added by ``select`` are
    copied into every later expression and filter that uses them; a generator
    row is not."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def center_y(y0: Column | str = "y0", y1: Column | str = "y1") -> Column:
    return (col(y0) + col(y1)) / F.lit(2.0)


def box_height(y0: Column | str = "y0", y1: Column | str = "y1") -> Column:
    """Height of a box, at least one pixel."""
    return F.greatest(col(y1) - col(y0), F.lit(1))


def list_order(words: DataFrame) -> DataFrame:
    """Make ``word_no`` the order in which a deduplicated page lists its words:
    most trusted first, earlier word first among equals. Ties in the geometric
    sorts downstream fall back to it."""
    return words.withColumn("word_no", F.struct((F.lit(0.0) - F.col("conf")).alias("less"), F.col("word_no").alias("no")))


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in
    ``spark.checkpoint.dir``. Only a local session without that setting gets a
    folder of its own."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="docreg-")
    context.setCheckpointDir(own)
    return own


_job: ContextVar[str | None] = ContextVar("job folder", default=None)


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """One folder below the shared one for all that a job writes on its way. Drop it
    with ``drop_folder`` once the job's result is written."""
    path = f"{shared_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    token = _job.set(path)
    try:
        yield path
    finally:
        _job.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a job's folder, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the job's folder, or under the shared folder."""
    base = _job.get() or shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def reliable(df: DataFrame) -> DataFrame:
    """Write a table under the shared folder and go on from there. It outlives a
    lost executor, cuts the lineage, and later steps read only the columns they
    need."""
    spark = df.sparkSession
    path = work_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a written table that a join may send to every task.
FEW_ROWS = 200_000


def sorted_if_many(written: DataFrame) -> DataFrame:
    """A written table that joins do not broadcast if it has many rows. The optimizer
    goes by the size of its files, in which rows that resemble each other take a
    hundredth of their memory; rows are counted from the files' footers."""
    return written.hint("merge") if written.count() > FEW_ROWS else written

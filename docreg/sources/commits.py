"""Numbered versions below a folder, committed one after another.

A version is a folder written by one job. Spark puts the marker ``_SUCCESS`` into it
last, so a version whose job was killed is never seen, and is overwritten when the
job runs again. One writer at a time is assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version}"


def last_version(spark: SparkSession, root: str) -> int | None:
    """The highest committed version; None before the first."""
    folder, files = _folder(spark, root)
    if not files.exists(folder):
        return None
    names = [status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory()]
    numbers = sorted((int(n.split("=")[1]) for n in names if n.startswith("version=")), reverse=True)
    marker = spark._jvm.org.apache.hadoop.fs.Path
    return next((n for n in numbers if files.exists(marker(f"{version_path(root, n)}/_SUCCESS"))), None)


def commit(df: DataFrame, root: str, version: int) -> None:
    """Write a version and with it the commit."""
    df.write.mode("overwrite").parquet(version_path(root, version))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder within its file system."""
    folder, files = _folder(spark, source)
    where, _ = _folder(spark, target)
    files.mkdirs(where.getParent())
    if not files.rename(folder, where):
        raise OSError(f"cannot move {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds."""
    folder, files = _folder(spark, path)
    return sorted(status.getPath().toString() for status in files.listStatus(folder)) if files.exists(folder) else []

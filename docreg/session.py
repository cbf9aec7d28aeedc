"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", memory: str = "8g") -> SparkSession:
    """Local session for tests and the bench. A cluster brings its own session;
    the jobs only rely on the UTC time zone and on adaptive execution."""
    partitions = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docreg")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )

"""Intake: which applications have all their documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["passport", "front", "back"]


def list_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, kind) of image files laid out as ``<app_id>/<kind>.<ext>``; the
    listing reads no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    place = r"([^/]+)/([^/.]+)\.[^/]+$"
    return files.select(
        F.regexp_extract("path", place, 1).alias("app_id"), F.regexp_extract("path", place, 2).alias("kind")
    )


def intake_status(manifest: DataFrame, required: Sequence[str] = tuple(REQUIRED)) -> DataFrame:
    """Per application: is it runnable, and which kinds are missing. Only the
    required kinds are gathered, so a group never grows beyond them."""
    wanted = F.array(*[F.lit(k) for k in required])
    have = manifest.groupBy("app_id").agg(
        F.collect_set(F.when(F.col("kind").isin(list(required)), F.col("kind"))).alias("_have")
    )
    return have.select(
        "app_id", F.array_join(F.array_except(wanted, "_have"), ",").alias("missing"),
        (F.size("_have") == len(required)).alias("complete"),
    )

"""Audit files into an event table, as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docreg.sources.audit_log import parse_audit


def stream_audit(spark: SparkSession, src: str, dst: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Parse every new log file once into parquet by day, then stop. The file
    sink's own log and the checkpoint make a rerun add nothing twice."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(src)
    events = parse_audit(lines).withColumn("day", F.to_date("ts"))
    return (
        events.writeStream.format("parquet").partitionBy("day")
        .option("path", dst).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

"""Record changes applied as they arrive.

State is the base table plus an append-only log of changes, one folder per batch of
a stream. A batch is written once, with overwrite, so a repeated batch replaces
itself; its folder carries the stream's own id, which lies in the checkpoint, so a
new checkpoint never touches the batches of an earlier one. Which changes apply is
decided on reading, so ids that join the base later are found. The cost of a batch
follows its own size; ``compact_records`` folds the log into a new base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docreg.operators.registry import latest_records, unknown_ids, upsert_records
from docreg.sources.record_store import CHANGES, RecordStore


def stream_records(
    spark: SparkSession, src: str, dst: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Change files (parquet, schema ``CHANGES``) under ``src`` go to
    ``dst/changes``, in one write per batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").parquet(f"{dst}/changes/stream={stream}/batch={batch_id}")

    changes = spark.readStream.schema(StructType.fromDDL(CHANGES)).option("maxFilesPerTrigger", files_per_batch).parquet(src)
    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_to_store(store: RecordStore, src: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Change files under ``src`` go to a record store, whose reads cost the base and a
    bounded number of pending changes. A batch that was killed, before its commit or
    after it, is not counted twice."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.apply_batch(stream, batch_id, batch)

    changes = store.spark.readStream.schema(StructType.fromDDL(CHANGES)).option("maxFilesPerTrigger", files_per_batch).parquet(src)
    return (
        changes.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _log(spark: SparkSession, dst: str) -> DataFrame:
    log = spark.read.schema(StructType.fromDDL(CHANGES)).option("recursiveFileLookup", "true").parquet(f"{dst}/changes")
    return log.select("id", "version", "ts", "fields")


def current_records(spark: SparkSession, dst: str) -> DataFrame:
    """The base with the latest change of each id it holds."""
    latest = latest_records(_log(spark, dst)).select("id", "fields")
    return upsert_records(spark.read.parquet(f"{dst}/base"), latest)[0]


def rejected_changes(spark: SparkSession, dst: str) -> DataFrame:
    """Changes to ids that the base does not hold."""
    return unknown_ids(_log(spark, dst), spark.read.parquet(f"{dst}/base"))


def compact_records(spark: SparkSession, dst: str, to: str) -> None:
    """Fold the log into a new base below ``to``. Changes to unknown ids stay a
    log there, so none is lost; point readers and the stream to ``to`` next."""
    current_records(spark, dst).write.parquet(f"{to}/base")
    rejected_changes(spark, dst).write.parquet(f"{to}/changes/stream=compacted/batch=0")

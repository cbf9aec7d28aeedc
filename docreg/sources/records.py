"""Records on disk: parquet with the field map as a JSON payload, plain or encrypted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "map<string, string>"


def _keyed(df: DataFrame, key: str | None) -> DataFrame:
    """The rows with the key as data of a one-row table: a literal could be read
    in every plan and event log."""
    if key is None:
        return df
    return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(key,)], "_key string")))


def encode_records(records: DataFrame, key: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Records with their map as a payload; ``also`` names further columns that stay."""
    payload = F.to_json("fields")
    if key is not None:
        payload = F.aes_encrypt(payload, F.col("_key"))
    return _keyed(records, key).select("id", "created_at", *also, payload.alias("payload"))


def decode_records(stored: DataFrame, key: str | None = None, also: Sequence[str] = ()) -> DataFrame:
    payload = F.col("payload")
    if key is not None:
        payload = F.aes_decrypt(payload, F.col("_key")).cast("string")
    return _keyed(stored, key).select("id", "created_at", *also, F.from_json(payload, _FIELDS).alias("fields"))


def write_records(records: DataFrame, path: str, key: str | None = None) -> None:
    """Append records. With ``key`` (16, 24 or 32 characters) the map is
    encrypted; id and creation time stay plain. Files are ranges of ids, sorted and
    with Bloom filters, so those without an id are skipped. ``record_store`` keeps that
    order over many writes."""
    clustered = encode_records(records, key).repartitionByRange("id").sortWithinPartitions("id")
    clustered.write.mode("append").option("parquet.bloom.filter.enabled#id", "true").parquet(path)


def read_records(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    return decode_records(spark.read.parquet(path), key)

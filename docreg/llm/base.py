"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as members of a character class.
SPACE = r"\x20\x09-\x0D"
#: The same characters as a string.
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Tables of up to so many short rows (some 10 MB) are sent to all tasks; larger ones are shuffled.
SENT_ROWS = 200_000


def sent(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A written table of short rows, marked for broadcast if it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def id_text(doc_id: Column) -> Column:
    """The id as text; a null id counts as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(parts)).cast("int")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    bare = F.btrim(text, F.lit(SPACES))
    runs = F.size(F.split(bare, f"[{SPACE}]+"))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(runs).cast("long")


# --- inside tasks: words of texts as numbers


def pieces(batch: pa.RecordBatch | pa.Table, column: str, most: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of a batch that hold about ``most`` bytes of a text column, one row
    at least. Whole rows only: no text is cut."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def coded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between ASCII white space, A-Z lowered: the number of words of each
    text, the code of each word in order, and the words by code."""
    counts = np.zeros(len(texts), dtype=np.int64)
    words: list[bytes] = []
    for i, text in enumerate(texts):
        if text:
            found = text.encode("utf-8", "surrogatepass").lower().split()
            counts[i] = len(found)
            words += found
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return counts, np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=_U64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mixed(a * _U64(0x9E3779B97F4A7C15) + b)


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

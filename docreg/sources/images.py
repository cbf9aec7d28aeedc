"""Images to words through a reader function of the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A reader takes the bytes of one image and gives (text, conf, x0, y0, x1, y1) rows.
Reader = Callable[[bytes], Iterable[tuple[str, float, int, int, int, int]]]

_SCHEMA = "path string, word_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int, error string"
_ROWS_PER_BATCH = 20_000


def image_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _checked(word: tuple) -> tuple:
    """A reader's row with the types the table has; a pixel must be whole."""
    text, conf, *corners = word
    whole = [int(c) for c in corners]
    if not isinstance(text, str) or len(whole) != 4 or any(a != b for a, b in zip(whole, corners)):
        raise ValueError(f"not a word: {word!r}")
    return text, float(conf), *whole


def extract_words(files: DataFrame, reader: Reader) -> DataFrame:
    """Words of each file, plus one row with ``error`` for each file the reader
    fails on; the job goes on. Reading is the costly step, so write the result
    before splitting it with ``split_reads``. Images reach a task in batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` files: set it low for large
    ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), *[pa.int32()] * 4, pa.string()]
        names = ["path", "word_no", "text", "conf", "x0", "y0", "x1", "y1", "error"]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(names)
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    words = [_checked(word) for word in reader(content.as_py())]
                    rows.extend((path, i, *word, None) for i, word in enumerate(words))
                except Exception as problem:  # noqa: BLE001 - one bad file must not end the job
                    rows.append((path, *[None] * 7, str(problem) or type(problem).__name__))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield flush()
        yield flush()

    return files.select("path", "content").mapInArrow(read, _SCHEMA)


def split_reads(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, errors)."""
    words = reads.filter(F.col("error").isNull()).drop("error")
    return words, reads.filter(F.col("error").isNotNull()).select("path", "error")

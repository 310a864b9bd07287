"""What the operators share: reading tables, document identity, written tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage, so a lost executor replays one stage only."""
    return materialise(df, name)


def documents(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` (null as empty) and `text_key`, a 64-bit digest of the text.

    (doc_id, text_key) is the identity of a document. Rows that repeat both are copies of one document and all get
    its result; rows that share only the id are different documents."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Null ids match each other."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])


def sha256_of_list(column: Column) -> Column:
    """Hex digest of the elements joined by commas."""
    return F.sha2(F.array_join(column, ","), 256)


#: Rows per batch between Spark and Python where texts go across.
TEXT_ROWS = 1_000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts are long rows: batches of Spark's default size would take tens of megabytes, several times over, in every
    task. Lowers the session's setting where it is higher."""
    if int(spark.conf.get(_BATCH_KEY)) > TEXT_ROWS or int(spark.conf.get(_BATCH_KEY)) <= 0:
        spark.conf.set(_BATCH_KEY, TEXT_ROWS)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made from one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls end to end, and the n + 1 offsets into them."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize)
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at.astype(np.int64) - int(at[0])

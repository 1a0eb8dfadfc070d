"""Arrow batches of documents for the operators that run in Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a batch that are turned to Python objects at a time; whole texts can be long.
SLICE = 256
#: And their bytes.
BYTES = 4_000_000


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, under fixed names: other columns, whatever their names, stay behind."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def row_key(id_col: str, text_col: str) -> Column:
    """The row's key with a hash of its text: a null key is a value like others, and rows that share a key stay apart."""
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))


def without_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in the one column of ``keys``; columns of ``docs`` may have any names."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("key"))
    kept = rows.join(keys.toDF("gone").distinct(), F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of ``rows`` rows at most whose texts or bytes (column 1) have ``BYTES`` at most; a longer text is a part of its own."""
    texts = batch.num_columns > 1 and (pa.types.is_string(batch.column(1).type) or pa.types.is_binary(batch.column(1).type))
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False) if texts else np.zeros(batch.num_rows, np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + BYTES, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``make()`` runs once in each task; what it returns maps slices of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                yield step(part)
        release()  # the worker stays, and may wait beside others' tasks

    return df.mapInArrow(run, schema)


def broadcast(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def release() -> None:
    """Gives memory back that is free but held by allocators, where the system's can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.session import ensure_checkpoint_dir, materialize

__all__ = ["arrow_map", "batch_texts", "chunks", "documents", "ensure_checkpoint_dir", "free_name", "materialize", "table", "text_bytes", "text_digest", "text_or_empty"]

#: Rows that a Python function handles at once; keeps a worker's memory bounded by its texts, not by its partition.
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(col: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return text_or_empty(col).cast("binary")


def text_digest(col: str = "text") -> tuple[Column, Column]:
    """Two hashes that tell texts apart."""
    return F.xxhash64(text_bytes(col)), F.xxhash64(F.lit(1), text_bytes(col))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` starts with it."""
    while any(c.lower().startswith(name.lower()) for c in docs.columns):
        name = f"_{name}"
    return name


def batch_texts(batch: pa.RecordBatch, text_col: str) -> pa.RecordBatch:
    """The column ``data``: UTF-8 bytes of a batch's own texts, empty for null, without a second copy sent along."""
    data = batch.column(text_col).cast(pa.string()).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pc.fill_null(data, b"") if data.null_count else data], ["data"])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column`` (one row at least)."""
    values = batch.column(column)
    start, held = 0, 0
    for k in range(batch.num_rows):
        size = len(values[k].as_buffer()) if values[k].is_valid else 0
        if k > start and held + size > limit:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``function`` to each Arrow batch of ``df``; it returns a batch of ``schema`` or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)

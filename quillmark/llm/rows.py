"""Shared inputs of the queries: word occurrences and verses with copies taken once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmark.sources.tables import table


def slices(batch: pa.RecordBatch, text: int, rows: int = 2048, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows and about ``size`` bytes of text; a longer text is a piece by itself, never cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def occurrences(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row for each (verse_id, position) of tokens; copies are combined before the shuffle."""
    t = table(spark, d, "tokens").where(F.col("verse_id").isNotNull() & F.col("position").isNotNull())
    return t.groupBy("verse_id", "position").agg(*(F.min(c).alias(c) for c in columns))


def verse_books(spark: SparkSession, d: str) -> DataFrame:
    """(verse_id, book) of verses, loads of one verse combined; verses without a book drop out."""
    v = table(spark, d, "verses").where(F.col("verse_id").isNotNull() & F.col("book").isNotNull())
    return v.groupBy("verse_id").agg(F.min("book").alias("book"))

"""Shared plumbing of the training-data operators: tables in the shared folder, safe columns, bounded broadcasts."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources import tables
from scriptorium.sources.tables import discard, exchange_parts, materialize, shared_dir

__all__ = ["crc_of_id", "discard", "documents", "exchange_parts", "materialize", "shared_dir", "ship_package", "text_or_empty", "tidy"]

#: Rows in an Arrow batch where the session leaves that unset: texts are long, and a worker holds whole batches.
BATCH_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package; keep their batches small unless the session has its own size."""
    if not spark._jsparkSession.sessionState().conf().contains("spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    tables.ship_package(spark)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """Unsigned crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy() -> None:
    """Give a worker's freed memory back to the machine: workers live on, and what they keep adds up over stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)

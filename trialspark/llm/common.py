"""Shared pieces of the corpus operators: query registry, text columns, packed binary columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY: dict[str, "LlmQuery"] = {}


@dataclass(frozen=True)
class LlmQuery:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


def query(name: str, oracle: str | None = None):
    """Register a corpus query; ``oracle`` is the same result in DuckDB SQL, if SQL can express it."""

    def register(fn):
        REGISTRY[name] = LlmQuery(name, fn, oracle)
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, where NULL counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: str = "text") -> Column:
    """UTF-8 bytes of the text, where NULL counts as empty."""
    return F.encode(text_of(column), "UTF-8")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a NULL column counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches whose binary column holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        start, rows = 0, batch.num_rows
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        ends = np.cumsum(lengths, dtype=np.int64)
        while start < rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [x or b"" for x in part.column(column).to_pylist()]
            start = stop


def release_unused() -> None:
    """Give memory that this Python worker has freed back to the system, as workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries trim by themselves
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, leaving no freed memory behind at the end of a task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        release_unused()

    return wrapped

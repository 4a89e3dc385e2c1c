"""Checksums of lists of ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def with_crc32(df: DataFrame, column: str, into: str = "ids_crc32") -> DataFrame:
    """df with the unsigned crc32 of a list of ids as little-endian unsigned 32-bit integers; null stays null."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(at).to_numpy(zero_copy_only=False)
            sums = [None if x is None else zlib.crc32(np.asarray(x).astype("<u4").tobytes()) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, into])

    return df.mapInArrow(run, StructType([*df.schema, StructField(into, LongType())]))

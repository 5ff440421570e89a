"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandframe.plans.numbering import forget
from strandframe.plans.numbering import shared_path as scratch_path
from strandframe.plans.numbering import stored

__all__ = ["ASCII_SPACE", "byte_view", "forget", "fresh", "ids_type", "scratch_path", "slices", "stored", "table"]

#: Code points that separate words everywhere in this subpackage: space and tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets, without a copy; null counts as empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Cuts a batch into runs of rows of about ``most`` bytes of text each, so that memory stays bounded."""
    at = byte_view(batch.column(column))[1]
    if not len(batch):
        return
    group = (at[:-1] - at[0]) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
        yield batch.slice(a, b - a)


def ids_type(df: DataFrame, column: str = "doc_id") -> str:
    """The SQL type of an id column, as it is written into the schemas of Python operators."""
    return df.schema[column].dataType.simpleString()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

"""The row-wise and additive operators on streams of reads.

Every operator that is a Column or a DataFrame function without an order works on a
stream as it is; aggregates are kept complete. Operators that need all indices (spans
with a checked start, exact samples, duplication samples) are for batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.operators import grep, qc, transform, verify
from strandframe.plans.matching import Search
from strandframe.schema import READS


def source(spark: SparkSession, folder: str, paired: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """Reads of Parquet files as they come into a folder."""
    reader = spark.readStream.schema(READS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    return df if paired else df.drop("x_header", "x_seq", "x_qual")


def matching(stream: DataFrame, s: Search) -> DataFrame:
    return grep.matching(stream, s)


def match_count(stream: DataFrame, s: Search) -> DataFrame:
    return grep.count(stream, s)


def sampled(stream: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return transform.sample_fraction(stream, fraction, seed)


def checksum(stream: DataFrame, **which) -> DataFrame:
    return verify.md5_checksum(stream, **which)


def gc_histogram(stream: DataFrame, mate: str = "s") -> DataFrame:
    """pct_gc, count of the values that have occurred."""
    from pyspark.sql import functions as F

    from strandframe.functions import seq as fn

    value = fn.gc_percent(F.col(f"{mate}_seq"))
    return stream.select(value.alias("pct_gc")).where("pct_gc is not null").groupBy("pct_gc").agg(F.count("*").alias("count"))


def length_histogram(stream: DataFrame, mate: str = "s") -> DataFrame:
    return qc.seq_length(stream, mate)

"""SAM text. BAM and CRAM need a library that isn't always there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an alignment line, from 0.
NAME, FLAG, SEQ, QUAL = 0, 1, 9, 10


def parse(lines: DataFrame) -> DataFrame:
    """flag, header, seq, qual of a ``value`` column of lines; header lines are left out. ``*`` is empty or missing."""
    cols = F.split("value", "\t")
    own = lines.where(~F.col("value").startswith("@") & (F.length("value") > 0))
    return own.select(
        F.get(cols, F.lit(FLAG)).cast("decimal(20,0)").alias("flag"),
        F.get(cols, F.lit(NAME)).alias("header"),
        F.when(F.get(cols, F.lit(SEQ)) == "*", "").otherwise(F.get(cols, F.lit(SEQ))).alias("seq"),
        F.when(F.get(cols, F.lit(QUAL)) != "*", F.get(cols, F.lit(QUAL))).alias("qual"),
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith((".bam", ".cram")):
        raise ValueError("BAM and CRAM aren't supported here; convert to SAM")
    return parse(spark.read.text(path))


def read_stream(spark: SparkSession, stream) -> DataFrame:
    text = stream.read()
    lines = (text.decode() if isinstance(text, bytes) else text).splitlines()
    return parse(spark.createDataFrame([(x,) for x in lines], "value string"))

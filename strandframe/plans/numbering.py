"""Contiguous numbers for rows, without a single-partition window."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which spark.checkpoint.dir names; nothing is written yet.

    Where that is unset, a temporary folder is made and set if one process runs
    everything, as in tests; on a cluster it is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it isn't computed again, and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has made, once what was computed from them is stored itself."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _numbered(placed: DataFrame, number: str) -> DataFrame:
    """Replaces the task-wise ``_place`` by numbers from 0: one small row per task is all the driver sees."""
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    if not sizes:
        return placed.withColumn(number, F.col("_place")).drop("_place")
    starts, total = [], 0
    for k in range(max(sizes) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    first = placed.sparkSession.createDataFrame([(k, s) for k, s in enumerate(starts) if k in sizes], "_part long, _start long")
    joined = placed.withColumn("_part", part).join(F.broadcast(first), "_part")  # one row per task
    return joined.withColumn(number, F.col("_start") + row).drop("_part", "_start", "_place")


def numbered(df: DataFrame, order: list[str], number: str = "idx") -> DataFrame:
    """Adds numbers from 0 in the given order: a range sort, the rows of each range counted, and their starts added."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    return _numbered(stored(ranged, "numbered"), number)


def numbered_as_read(df: DataFrame, number: str = "idx") -> DataFrame:
    """Adds numbers from 0 in the order in which the partitions hold the rows."""
    return _numbered(stored(df.withColumn("_place", F.monotonically_increasing_id()), "numbered"), number)

"""Reads from text files, and stored sets of them."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.combine import interleaved, zipped
from strandframe.plans.numbering import numbered_as_read
from strandframe.plans.parse import encoded_name, input_format, output_variant
from strandframe.schema import Meta
from strandframe.sources import fastx, files, sam
from strandframe.sources.variants import exists, remove, write_set

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Job:
    inputs: tuple[str, ...]
    output: str
    kind: str  # single, paired or interleaved


def as_single(rows: DataFrame) -> DataFrame:
    """idx, flag, s_header, s_seq, s_qual of header, seq, qual."""
    flag = F.col("flag") if "flag" in rows.columns else F.lit(None).cast("decimal(20,0)")
    return rows.select("idx", flag.alias("flag"), F.col("header").alias("s_header"), F.col("seq").alias("s_seq"), F.col("qual").alias("s_qual"))


def load(spark: SparkSession, inputs: list[str], kind: str = "single", given_format: str | None = None, range_bytes: int = fastx.RANGE_BYTES) -> DataFrame:
    """Numbered reads of one file, of a pair of files, or of one file with alternating mates.

    The files of a pair must hold equally many records, an interleaved one an even number.
    """
    if input_format(inputs, given_format) == "sam":
        rows = sam.scan(spark, inputs[0])
        numbered = numbered_as_read(rows)
        return interleaved(_even(numbered)) if kind == "interleaved" else as_single(numbered)
    if kind == "paired":
        if len(inputs) != 2:
            raise ValueError("a pair is two files")
        first, second = (numbered_as_read(fastx.scan(spark, [p], range_bytes)) for p in inputs)
        if first.count() != second.count():
            raise ValueError("the files of the pair differ in their number of records")
        return zipped(first, second)
    rows = numbered_as_read(fastx.scan(spark, inputs, range_bytes))
    return interleaved(_even(rows)) if kind == "interleaved" else as_single(rows)


def _even(rows: DataFrame) -> DataFrame:
    n = rows.count()
    if n == 0:
        raise ValueError("an interleaved input must not be empty")
    if n % 2:
        raise ValueError("the last record of an interleaved input has no mate")
    return rows


def load_stream(spark: SparkSession, stream, output: str | None, given_format: str | None = None, variant: str = "cbq") -> DataFrame:
    """Reads of standard input; there must be a named output."""
    if not output:
        raise ValueError("an output is needed for reads from standard input")
    if given_format == "b":
        if variant == "bq":
            raise ValueError("bq can't be made from SAM on standard input")
        return as_single(numbered_as_read(sam.read_stream(spark, stream)))
    return as_single(numbered_as_read(fastx.read_stream(spark, stream)))


def plan_jobs(inputs: list[str], output: str | None = None, variant: str | None = None, paired: bool = False, interleave: bool = False, collate: bool = False) -> list[Job]:
    """What to encode into what. Two inputs are a pair, unless collated or interleaved; more are one job each, or one in all."""
    kind = output_variant(output, variant)
    if collate:
        if not output:
            raise ValueError("a collated output needs a name")
        return [Job(tuple(inputs), output, "interleaved" if interleave else "single")]
    if len(inputs) == 2 and not interleave:
        return [Job(tuple(inputs), output or encoded_name(inputs[0], kind, True), "paired")]
    if paired:
        couples, alone = files.pairs(inputs)
        for p in alone:
            log.warning("%s has no mate and is left out", p)
        jobs = [Job(p, encoded_name(p[0], kind, True), "paired") for p in couples]
    else:
        jobs = [Job((p,), encoded_name(p, kind), "interleaved" if interleave else "single") for p in inputs]
    if output:
        if len(jobs) > 1:
            log.warning("there are several outputs; %s is ignored", output)
        else:
            jobs = [Job(j.inputs, output, j.kind) for j in jobs]
    return jobs


def run(spark: SparkSession, jobs: list[Job], meta: Meta, policy: str = "r", given_format: str | None = None) -> dict[str, dict]:
    """Runs jobs one after the other, each on all tasks. With several, a failing one is logged, its output removed, and the rest go on.

    An output that is there already is an error, and stays.
    """
    out = {}
    for job in jobs:
        there = exists(job.output)
        try:
            if there:
                raise ValueError(f"{job.output!r} is there already")
            df = load(spark, list(job.inputs), job.kind, given_format)
            fasta = "s_qual" in df.columns and not df.where("s_qual is not null").limit(1).count()
            own = meta.with_(paired=job.kind != "single", quality=meta.quality and not fasta)
            n = df.count()
            write_set(df, job.output, own, policy)
            written = spark.read.parquet(job.output.rstrip("/") + "/data").count()
            out[job.output] = {"written": written, "skipped": n - written}
        except Exception:
            if not there:
                remove(job.output)
            if len(jobs) == 1:
                raise
            log.exception("%s failed", job.inputs)
    return out

"""Row-wise operators: reverse complement, sampling, N policy, records as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import seq as fn
from strandframe.plans.matching import in_span
from strandframe.plans.numbering import numbered
from strandframe.plans.parse import Span
from strandframe.schema import is_paired

#: Sampled reads that are found as a top-k.
TOP = 100_000


def revcomp(df: DataFrame, mate: str = "both", span: Span | None = None) -> DataFrame:
    """Sequences of the mate reverse-complemented, qualities reversed; headers stay. Single reads are flipped whatever the mate."""
    out = in_span(df, span or Span())
    wanted = {"1": "s", "2": "x", "both": "sx"}[mate] if is_paired(df) else "s"
    for m in wanted:
        if f"{m}_seq" in df.columns:
            out = out.withColumn(f"{m}_seq", fn.reverse_complement(F.col(f"{m}_seq")))
        if f"{m}_qual" in df.columns:
            out = out.withColumn(f"{m}_qual", F.reverse(F.col(f"{m}_qual")))
    return out


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42, span: Span | None = None) -> DataFrame:
    """Each read with a probability; the choice depends on its index and the seed only, not on partitions."""
    return in_span(df, span or Span()).where(fn.sampled(F.col("idx"), fraction, seed))


def sample_number(df: DataFrame, n: int, seed: int = 42, span: Span | None = None) -> DataFrame:
    """Exactly n reads (or all, if there are fewer): those with the smallest draws.

    Up to TOP reads, that is a top-k and no sort. More are ranked by a range sort on all
    tasks, as a limit would bring them into one.
    """
    own, draw = in_span(df, span or Span()), fn.draw(F.col("idx"), seed)
    if n <= TOP:
        return own.orderBy(draw, "idx").limit(n)
    ranked = numbered(own.withColumn("_draw", draw), ["_draw", "idx"], "_rank")
    return ranked.where(F.col("_rank") < n).drop("_draw", "_rank")


def n_policy(df: DataFrame, policy: str, seed: int = 42) -> DataFrame:
    """What two-bit storage does with N: i drops the read, p fails, r draws a base, a c g t put that base."""
    mates = [m for m in ("s_seq", "x_seq") if m in df.columns]
    has = F.lit(False)
    for m in mates:
        has = has | F.coalesce(F.contains(F.col(m), F.lit("N")), F.lit(False))
    if policy == "i":
        return df.where(~has)
    if policy == "p":
        return df.withColumn("s_seq", F.when(has, F.raise_error(F.lit("a sequence holds N"))).otherwise(F.col("s_seq")))
    for k, m in enumerate(mates):
        if policy == "r":
            df = df.withColumn(m, fn.random_bases(F.col(m), F.col("idx"), seed + k))
        elif policy in ("a", "c", "g", "t"):
            df = df.withColumn(m, F.translate(F.col(m), "N", policy.upper()))
        else:
            raise ValueError(f"unknown policy {policy!r}")
    return df


def records(df: DataFrame, mate: str = "both") -> DataFrame:
    """(idx, mate, header, seq, qual): one row per record. Of both mates, the second goes if its sequence is empty; single reads are mate 1."""
    paired = is_paired(df)
    have = set(df.columns)

    def one(m: str, k: int) -> Column:
        header = F.col(f"{m}_header") if f"{m}_header" in have else F.lit(None).cast("string")
        qual = F.col(f"{m}_qual") if f"{m}_qual" in have else F.lit(None).cast("string")
        fallback = F.col("idx").cast("string")
        return F.struct(F.lit(k).alias("mate"), F.coalesce(header, fallback).alias("header"), F.col(f"{m}_seq").alias("seq"), qual.alias("qual"))

    if not paired or mate == "1":
        return df.select("idx", F.inline(F.array(one("s", 1))))
    if mate == "2":
        return df.select("idx", F.inline(F.array(one("x", 2))))
    return df.select("idx", F.inline(F.array(one("s", 1), one("x", 2)))).where((F.col("mate") == 1) | (F.length("seq") > 0))


def record_text(kind: str) -> Column:
    """The text of a record, without the last line feed, over the columns of ``records``."""
    if kind == "fasta":
        return F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("seq"))
    if kind == "fastq":
        return F.concat(F.lit("@"), F.col("header"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), fn.filled_quality(F.col("qual"), F.col("seq")))
    if kind == "tsv":
        return F.concat(F.col("header"), F.lit("\t"), F.col("seq"))
    raise ValueError(f"unknown format {kind!r}")


def decode(df: DataFrame, kind: str = "tsv", mate: str = "both", span: Span | None = None) -> DataFrame:
    """(idx, mate, record)."""
    return records(in_span(df, span or Span()), mate).select("idx", "mate", record_text(kind).alias("record"))


def shard_number(n: int, start: int, end: int) -> Column:
    """Of ``idx``: n ranges of equal size in order, the last with the rest."""
    each = (end - start) // n
    number = F.least(F.expr(f"(idx - {start}) div {each}"), F.lit(n - 1)) if each else F.lit(n - 1)
    return number.cast("int")


def shards(df: DataFrame, n: int, start: int, end: int) -> DataFrame:
    """Adds ``shard``."""
    return in_span(df, Span(start, end)).withColumn("shard", shard_number(n, start, end))

"""Operators over several sets or outputs: cat, split, pairing and interleaving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.plans.matching import Search, in_span, plan
from strandframe.schema import ReadSet, conform, is_paired

UNMATCHED = "unmatched"


def cat(sets: list[ReadSet]) -> ReadSet:
    """All reads of sets with equal properties, numbered on from set to set. Properties are checked before anything is read."""
    if not sets:
        raise ValueError("nothing to concatenate")
    for other in sets[1:]:
        if other.meta != sets[0].meta:
            raise ValueError("the sets differ in variant or header")
    shifted, start = [], 0
    for s in sets:
        shifted.append(s.df.withColumn("idx", F.col("idx") + F.lit(start)))
        if s is not sets[-1]:
            start += s.df.agg(F.coalesce(F.max("idx") + 1, F.lit(0))).first()[0]
    return ReadSet(reduce(DataFrame.unionByName, shifted), sets[0].meta)


def aliases(df: DataFrame, s: Search) -> tuple[Column, list[str]]:
    """The set of aliases that a read matches, and all aliases."""
    p = plan(s, is_paired(df))
    by: dict[str, Column] = {}
    for x, hit in zip(p.patterns, p.hits(), strict=True):
        by[x.alias] = by[x.alias] | hit if x.alias in by else hit
    found = F.filter(F.array(*[F.when(hit, F.lit(a)) for a, hit in by.items()]), lambda a: a.isNotNull())
    return found, list(by)


def routed(df: DataFrame, s: Search, unmatched: str = UNMATCHED, skip_unmatched: bool = False) -> DataFrame:
    """Adds ``alias``: the one that a read matches, or ``unmatched`` for none or several."""
    if s.header or not s.within.full:
        raise ValueError("split looks at whole sequences")
    found, names = aliases(df, s)
    if not skip_unmatched and unmatched in names:
        raise ValueError(f"a pattern is called {unmatched!r}")
    own = in_span(df, s.span).withColumn("_found", found)
    out = own.withColumn("alias", F.when(F.size("_found") == 1, F.get("_found", F.lit(0))).otherwise(F.lit(unmatched))).drop("_found")
    return out.where(F.col("alias") != unmatched) if skip_unmatched else out


def tallies(df: DataFrame, s: Search, unmatched: str = UNMATCHED, skip_unmatched: bool = False) -> DataFrame:
    """alias, count of every output, with empty ones."""
    names = [*aliases(df, s)[1], *([] if skip_unmatched else [unmatched])]
    counts = routed(df, s, unmatched, skip_unmatched).groupBy("alias").agg(F.count("*").alias("n"))
    all_names = df.sparkSession.createDataFrame([(a,) for a in names], "alias string")
    return all_names.join(counts, "alias", "left").select("alias", F.coalesce("n", F.lit(0)).alias("count"))


def split(df: DataFrame, s: Search, min_records: int = 1, **names) -> DataFrame:
    """Routed reads of the outputs that have at least ``min_records``."""
    big = tallies(df, s, **names).where(F.col("count") >= min_records).select("alias")
    return routed(df, s, **names).join(F.broadcast(big), "alias", "left_semi")  # one row per alias


def zipped(first: DataFrame, second: DataFrame) -> DataFrame:
    """R1 and R2 (idx, header, seq, qual) side by side by number."""
    a = first.select("idx", *[F.col(c).alias(f"s_{c}") for c in ("header", "seq", "qual")])
    b = second.select("idx", *[F.col(c).alias(f"x_{c}") for c in ("header", "seq", "qual")])
    return a.join(b, "idx")


def interleaved(df: DataFrame) -> DataFrame:
    """Records 2i and 2i + 1 of (idx, header, seq, qual) as pair i."""

    def of(mate: int, c: str) -> Column:
        return F.max(F.when(F.col("idx") % 2 == mate, F.col(c)))

    pairs = df.groupBy(F.expr("idx div 2").alias("idx"))
    return pairs.agg(*[of(k, c).alias(f"{m}_{c}") for k, m in enumerate("sx") for c in ("header", "seq", "qual")])


def written_split(df: DataFrame, folder: str) -> None:
    """One folder per alias below ``folder``, each a set of reads."""
    conform_columns = [c for c in conform(df).columns if c in df.columns]
    df.select("alias", *conform_columns).write.partitionBy("alias").option("compression", "zstd").parquet(folder)

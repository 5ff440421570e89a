"""Search: rows, counts, shares, and counts by pattern."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import seq as fn
from strandframe.functions.fuzzy import matches
from strandframe.plans.matching import Plan, Search, in_span, java_regex, plan
from strandframe.schema import is_paired

try:
    import ahocorasick
except ImportError:  # then many literals are joined instead
    ahocorasick = None

#: From so many literal patterns on, reads aren't searched once per pattern.
MANY = 48
#: Pattern tables up to this size are broadcast.
SMALL_BYTES = 8 << 20


def matching(df: DataFrame, s: Search) -> DataFrame:
    """Reads of the span that match."""
    return in_span(df, s.span).where(plan(s, is_paired(df)).predicate())


def count(df: DataFrame, s: Search) -> DataFrame:
    """count, total and frac (four digits)."""
    p = plan(s, is_paired(df)).predicate()
    both = in_span(df, s.span).agg(F.count_if(p).alias("count"), F.count("*").alias("total"))
    return both.withColumn("frac", F.format_string("%.4f", fn.ratio(F.col("count"), F.col("total"))))


def _by_scan(df: DataFrame, p: Plan) -> DataFrame:
    hits = p.hits()
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(h).alias(f"n{k}") for k, h in enumerate(hits)])
    rows = [F.struct(F.lit(k).alias("pid"), F.lit(x.alias).alias("name"), F.col(f"n{k}").alias("n")) for k, x in enumerate(p.patterns)]
    return counts.select("total", F.inline(F.array(*rows)))


def words(column: Column, length: int) -> Column:
    """The different substrings of a length."""
    places = F.when(F.length(column) >= length, F.sequence(F.lit(1), F.length(column) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(column, i, F.lit(length))))


def _by_words(df: DataFrame, p: Plan) -> DataFrame:
    """Each read gives its different words of a pattern length and scope once, so a hit counts once per read."""
    spark = df.sparkSession
    groups: dict[tuple[str, int], list[tuple[int, str]]] = defaultdict(list)
    for k, x in enumerate(p.patterns):
        groups[x.scope, len(x.text)].append((k, x.text))
    found = None
    for (scope, length), own in groups.items():
        parts = [words(p.sequence(m), length) for m in p.mates(scope)]
        each = df.select(F.explode(parts[0] if len(parts) == 1 else F.array_union(*parts)).alias("word"))
        table = spark.createDataFrame(own, "pid int, word string")
        if sum(len(t) + 16 for _, t in own) <= SMALL_BYTES:
            table = F.broadcast(table)
        hits = each.join(table, "word").groupBy("pid").agg(F.count("*").alias("n"))
        found = hits if found is None else found.union(hits)
    return _named(df, p, found)


def _by_automaton(df: DataFrame, p: Plan) -> DataFrame:
    """Each batch of reads goes through one Aho-Corasick automaton per mate; a task passes on one row for each pattern it found."""
    mates = ["s", "x"] if p.paired else ["s"]
    own = df.select(*[p.sequence(m).alias(m) for m in mates])

    def run(batches):
        made = []
        for m in mates:
            by: dict[str, list[int]] = defaultdict(list)
            for k, x in enumerate(p.patterns):
                if m in p.mates(x.scope):
                    by[x.text].append(k)
            automaton = ahocorasick.Automaton()
            for text, pids in by.items():
                automaton.add_word(text, pids)
            automaton.make_automaton()
            made.append(automaton if by else None)
        counts = [0] * len(p.patterns)
        for batch in batches:
            columns = [(made[i], batch.column(i).to_pylist()) for i in range(len(mates)) if made[i] is not None]
            for row in range(len(batch)):
                found = {pid for automaton, texts in columns for _, pids in automaton.iter(texts[row]) for pid in pids}
                for pid in found:
                    counts[pid] += 1
        hits = [k for k, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int32()), pa.array([counts[k] for k in hits], pa.int64())], ["pid", "n"])

    found = own.mapInArrow(run, "pid int, n long").groupBy("pid").agg(F.sum("n").alias("n"))
    return _named(df, p, found)


def _named(df: DataFrame, p: Plan, found: DataFrame) -> DataFrame:
    """All patterns with their counts, and the number of reads."""
    names = df.sparkSession.createDataFrame([(k, x.alias) for k, x in enumerate(p.patterns)], "pid int, name string")
    total = df.agg(F.count("*")).scalar()
    return names.join(found, "pid", "left").select("pid", "name", F.coalesce("n", F.lit(0)).alias("n"), total.alias("total"))


def pattern_counts(df: DataFrame, s: Search, many: int = MANY, how: str | None = None) -> DataFrame:
    """pid, name, count, frac_total of each pattern, with those that nothing matches; inverted: of the reads that lack it.

    how: scan (a predicate per pattern), automaton, or words (a join on substrings);
    by default scan below ``many`` literals, else the automaton where its library is there.
    """
    p = plan(s, is_paired(df))
    own = in_span(df, s.span)
    if how is None:
        literal = p.backend == "fixed" and len(p.patterns) >= many and all(x.text for x in p.patterns)
        how = ("automaton" if ahocorasick is not None else "words") if literal else "scan"
    out = {"scan": _by_scan, "automaton": _by_automaton, "words": _by_words}[how](own, p)
    n = F.col("total") - F.col("n") if s.invert else F.col("n")
    return out.select("pid", "name", n.alias("count"), fn.ratio(n, F.col("total")).alias("frac_total")).orderBy("pid")


def _regex_spans(column: Column, text: str, shift: int) -> Column:
    """Places of a regular expression that don't overlap: what is between the matches gives where they start.

    A match without letters counts unless it stands right behind another match.
    """
    made = F.lit(java_regex(text))
    found = F.regexp_extract_all(column, made, F.lit(0))
    between = F.split(column, made, -1)
    # nothing stands before a match without letters at the start, and split leaves that out
    between = F.when(F.size(between) > F.size(found), between).otherwise(F.concat(F.array(F.lit("")), between))
    each = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("match"))
    none = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["match"])
        kept = F.when((a == b) & (acc["last"] == a), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((a + shift).alias("a"), (b + shift).alias("b")))))
        return F.struct(b.alias("at"), b.alias("last"), kept.alias("out"))

    return F.aggregate(each, none, step, lambda acc: acc["out"])


def _fuzzy_spans(column: Column, text: str, how, shift: int) -> Column:
    @F.pandas_udf("array<struct<a:int,b:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a + shift, "b": b + shift} for a, b, _ in x] for x in matches(texts.fillna("").tolist(), text, how)])

    return found(column)


def spans(df: DataFrame, s: Search) -> DataFrame:
    """Matching reads with s_spans and, of pairs, x_spans: half-open hits, numbered from the start of the whole sequence."""
    p = plan(s, is_paired(df))
    shift = s.within.start
    out = matching(df, s)
    for mate in ("s", "x") if p.paired else ("s",):
        parts = []
        for x in p.patterns:
            if mate in p.mates(x.scope):
                column = p.sequence(mate)
                if p.backend == "fixed":
                    parts.append(fn.fixed_spans(column, x.text, shift))
                elif p.backend == "regex":
                    parts.append(_regex_spans(column, x.text, shift))
                else:
                    parts.append(_fuzzy_spans(column, x.text, s.fuzzy, shift))
        empty = F.array().cast("array<struct<a:int,b:int>>")
        out = out.withColumn(f"{mate}_spans", F.array_sort(F.concat(*parts)) if parts else empty)
    return out


def highlighted(df: DataFrame, s: Search) -> DataFrame:
    """Matching reads with their hits coloured in sequences and qualities; inverted searches and headers stay plain."""
    if s.invert or s.header:
        return matching(df, s)
    out = spans(df, s)
    for mate in ("s", "x") if is_paired(df) else ("s",):
        for part in ("seq", "qual"):
            name = f"{mate}_{part}"
            if name in df.columns:
                out = out.withColumn(f"_{name}", F.when(F.col(name).isNotNull(), fn.highlighted(F.col(name), F.col(f"{mate}_spans"))))
    swapped = {c[1:]: F.col(c) for c in out.columns if c.startswith("_")}
    return out.select(*[swapped.get(c, F.col(c)).alias(c) for c in df.columns])

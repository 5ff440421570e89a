"""Queries over reads that are derived from the driver's tables, with the SQL to hold them against."""

from __future__ import annotations

import os
import re
import shutil
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import seq as fn
from strandframe.functions.fuzzy import Fuzzy
from strandframe.operators import combine, encode, grep, pipe, qc, transform, verify
from strandframe.plans import numbering, parse
from strandframe.plans.matching import in_span, search
from strandframe.plans.parse import Range, Span
from strandframe.schema import Meta, ReadSet
from strandframe.sources import files, patterns, sinks, variants
from strandframe.sources.patterns import Pattern

_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_known: dict[tuple[str, str], str] = {}


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired reads made of lineitem, in order within each task.

    The sort is over the few numbers that reads are made of, as sorted texts would spill.
    """
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_KEYS)
    n = numbering.numbered(t, _KEYS).sortWithinPartitions("idx")
    text = lambda c: F.col(c).cast("string")
    two = lambda p, a, q, b: F.concat(F.md5(F.concat(F.lit(p), text(a))), F.md5(F.concat(F.lit(q), text(b))))
    letters = lambda hashes, n, to: F.translate(F.substring(hashes, F.lit(1), n), "0123456789abcdef", to)
    n = n.withColumns({"h": F.concat(F.lit("r"), text("idx")), "n": (F.col("l_linenumber") * 3 + 40).cast("int")})
    bases = letters(two("a", "l_partkey", "b", "l_partkey"), F.col("n"), "ACGTACGTACGTACGN")
    marks = letters(two("q", "l_orderkey", "p", "l_linenumber"), F.greatest("n", F.lit(40)), "!#5:?ACDEFGHIIII")
    n = n.withColumns({"s0": bases, "x0": letters(two("c", "l_suppkey", "d", "l_orderkey"), F.lit(40), "ACGTACGTACGTACGT"), "q0": marks})
    return n.select(
        "idx", F.col("h").alias("s_header"), F.col("s0").alias("s_seq"), F.substring("q0", F.lit(1), F.col("n")).alias("s_qual"),
        F.col("h").alias("x_header"), F.col("x0").alias("x_seq"), F.substring("q0", 1, 40).alias("x_qual"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived reads. They are numbered and stored once per session, as an encoded file would be."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _known:
        path = numbering.shared_path(spark, "reads")
        derived(spark, sf_dir).write.option("compression", "zstd").parquet(path)
        _known[at] = path
    return spark.read.parquet(_known[at])


READS_SQL = """
WITH reads AS (
  SELECT idx, concat('r', CAST(idx AS VARCHAR)) AS s_header, substring(s0, 1, 40 + ln * 3) AS s_seq, substring(q0, 1, 40 + ln * 3) AS s_qual,
         concat('r', CAST(idx AS VARCHAR)) AS x_header, substring(x0, 1, 40) AS x_seq, substring(q0, 1, 40) AS x_qual
  FROM (
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS idx, l_linenumber AS ln,
           translate(concat(md5(concat('a', CAST(l_partkey AS VARCHAR))), md5(concat('b', CAST(l_partkey AS VARCHAR)))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS s0,
           translate(concat(md5(concat('c', CAST(l_suppkey AS VARCHAR))), md5(concat('d', CAST(l_orderkey AS VARCHAR)))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS x0,
           translate(concat(md5(concat('q', CAST(l_orderkey AS VARCHAR))), md5(concat('p', CAST(l_linenumber AS VARCHAR)))), '0123456789abcdef', '!#5:?ACDEFGHIIII') AS q0
    FROM lineitem) t
)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(reads(spark, sf_dir))
        if sql is not None:
            SQL[name] = READS_SQL + sql
        return f

    return add


def _e(p: str) -> str:
    return f"(contains(s_seq, '{p}') OR contains(x_seq, '{p}'))"


def _rows(name: str, s, where: str) -> None:
    _query(name, f"SELECT idx, s_seq, x_seq FROM reads WHERE {where}")(lambda df, s=s: grep.matching(df, s).select("idx", "s_seq", "x_seq"))


_rows("grep_either", search(["GATTA"]), _e("GATTA"))
_rows("grep_and", search(["GATT", "CCCC"]), f"{_e('GATT')} AND {_e('CCCC')}")
_rows("grep_or", search(["GATTAC", "CCCCC"], logic="or"), f"{_e('GATTAC')} OR {_e('CCCCC')}")
_rows("grep_invert", search(["GAT", "CCC"], invert=True), f"NOT ({_e('GAT')} AND {_e('CCC')})")
_rows("grep_primary_only", search(primary=["GATTA"]), "contains(s_seq, 'GATTA')")
_rows("grep_extended_only", search(extended=["GATTA"]), "contains(x_seq, 'GATTA')")
_rows("grep_scopes", search(["ACG"], ["GAT"], ["TTA"]), f"{_e('ACG')} AND contains(s_seq, 'GAT') AND contains(x_seq, 'TTA')")
_rows("grep_mate1", search(["TTTT"], mate="1"), "contains(s_seq, 'TTTT')")
_rows("grep_mate2", search(["TTTT"], mate="2"), "contains(x_seq, 'TTTT')")
_rows("grep_range", search(["TTACA"], within=Range(2, 20)), "contains(substring(s_seq, 3, 18), 'TTACA') OR contains(substring(x_seq, 3, 18), 'TTACA')")
_rows("grep_range_anchored", search(["^ATT.A"], within=Range(1)), "regexp_matches(substring(s_seq, 2), '^ATT.A') OR regexp_matches(substring(x_seq, 2), '^ATT.A')")
_rows("grep_header_regex", search(["^r[0-9]*77$"], header=True), "regexp_matches(s_header, '^r[0-9]*77$') OR regexp_matches(x_header, '^r[0-9]*77$')")
_rows("grep_regex", search(["ACG[AC]TT?G"]), "regexp_matches(s_seq, 'ACG[AC]TT?G') OR regexp_matches(x_seq, 'ACG[AC]TT?G')")
_rows("grep_regex_end", search(["GAT$"]), "regexp_matches(s_seq, 'GAT$') OR regexp_matches(x_seq, 'GAT$')")
_rows("grep_header_posix", search(["^r[[:digit:]]{2}[[:alpha:]]?$"], header=True), "regexp_matches(s_header, '^r[0-9]{2}[a-zA-Z]?$')")
_rows("grep_regex_posix", search(["AC[[:upper:]]{3}TTT[[:^digit:]]A"]), "regexp_matches(s_seq, 'AC[A-Z]{3}TTT[^0-9]A') OR regexp_matches(x_seq, 'AC[A-Z]{3}TTT[^0-9]A')")
_rows("grep_regex_group", search(["(?P<x>GAT)+TACA"]), "regexp_matches(s_seq, '(GAT)+TACA') OR regexp_matches(x_seq, '(GAT)+TACA')")
_rows("grep_rc", search(["TGTAATC"], rc=True), _e("GATTACA"))
_rows("grep_fixed_flag", search(["GATN"], fixed=True), _e("GATN"))
_rows("grep_span", search(["GAT"], span=Span(100, 5000)), f"{_e('GAT')} AND idx >= 100 AND idx < 5000")

SINGLE = ("idx", "s_header", "s_seq", "s_qual")


@_query("grep_count", f"SELECT CAST(count(*) AS BIGINT) AS n FROM reads WHERE {_e('ACGTAC')}")
def _(df):
    return grep.matching(df, search(["ACGTAC"])).agg(F.count("*").alias("n"))


@_query("grep_frac", f"SELECT CAST(count(*) FILTER ({_e('GATTA')}) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS total, printf('%.4f', count(*) FILTER ({_e('GATTA')}) / count(*)) AS frac FROM reads")
def _(df):
    return grep.count(df, search(["GATTA"]))


@_query("grep_single_end", "SELECT idx, s_seq FROM reads WHERE contains(s_seq, 'GATTA')")
def _(df):
    return grep.matching(df.select(*SINGLE), search(["GATTA"])).select("idx", "s_seq")


_COUNTED = ["AAAA", "CCCC", "GATTACA", "AAAA", "ACGTNN"]
_VALUES = ", ".join(f"({k}, '{p}')" for k, p in enumerate(_COUNTED))
_COUNT_SQL = f"""
SELECT CAST(pid AS INTEGER) AS pid, p.pattern AS name, CAST({{n}} AS BIGINT) AS count, {{n}} / count(*) AS frac_total
FROM reads CROSS JOIN (VALUES {_VALUES}) p(pid, pattern) GROUP BY pid, p.pattern
"""
_HITS = "count(*) FILTER (contains(s_seq, p.pattern) OR contains(x_seq, p.pattern))"


@_query("grep_pattern_count", _COUNT_SQL.format(n=_HITS))
def _(df):
    return grep.pattern_counts(df, search(_COUNTED, fixed=True))


@_query("grep_pattern_count_invert", _COUNT_SQL.format(n=f"(count(*) - {_HITS})"))
def _(df):
    return grep.pattern_counts(df, search(_COUNTED, fixed=True, invert=True))


def _many(n: int, length: int) -> list[str]:
    """Patterns from a rule: the numbers of a Lehmer sequence in base four."""
    out, x = [], 7
    for _ in range(n):
        x = x * fn.STEP_A % fn.PRIME
        out.append("".join("ACGT"[x >> (2 * k) & 3] for k in range(length)))
    return out


_MANY = [*_many(60, 6), *_many(60, 8)]


_MANY_SQL = (
    "SELECT CAST(pid AS INTEGER) AS pid, p.pattern AS name, CAST(" + _HITS + " AS BIGINT) AS count, " + _HITS + " / count(*) AS frac_total FROM reads CROSS JOIN (VALUES "
    + ", ".join(f"({k}, '{p}')" for k, p in enumerate(_MANY))
    + ") p(pid, pattern) GROUP BY pid, p.pattern"
)


@_query("grep_pattern_count_kmer_join", _MANY_SQL)
def _(df):
    return grep.pattern_counts(df, search(_MANY), how="words")


@_query("grep_pattern_count_many", _MANY_SQL)
def _(df):
    return grep.pattern_counts(df, search(_MANY))


@_query(
    "grep_fuzzy_k1",
    """SELECT idx, x_seq FROM reads WHERE idx IN (
         SELECT idx FROM (SELECT idx, x_seq, unnest(range(1, length(x_seq) + 1)) AS a FROM reads) u CROSS JOIN (VALUES (6), (7), (8)) n(n)
         WHERE a + n <= length(x_seq) + 1 AND levenshtein(substring(x_seq, a, n), 'GATTACA') <= 1)""",
)
def _(df):
    return grep.matching(df, search(extended=["GATTACA"], fuzzy=Fuzzy(1))).select("idx", "x_seq")


@_query("grep_fuzzy_inexact")
def _(df):
    return grep.matching(df, search(["GATTACAG"], fuzzy=Fuzzy(1, inexact=True))).select("idx", "s_seq", "x_seq")


@_query("grep_fuzzy_nfrac")
def _(df):
    return grep.matching(df, search(primary=["GATTACAG"], fuzzy=Fuzzy(2, max_n_frac=0.0))).select("idx", "s_seq")


@_query(
    "grep_spans_fixed",
    "SELECT idx, CAST(len(p) AS INTEGER) AS n, CAST(p[1] AS INTEGER) AS first, CAST(p[-1] + 4 AS INTEGER) AS last_end FROM (SELECT idx, list_filter(range(0, length(s_seq) - 3), lambda i: substring(s_seq, CAST(i AS INTEGER) + 1, 4) = 'ACAC') AS p FROM reads) u WHERE len(p) > 0",
)
def _(df):
    out = grep.spans(df, search(primary=["ACAC"]))
    spans = F.col("s_spans")
    return out.select("idx", F.size(spans).alias("n"), F.get(spans, F.lit(0))["a"].alias("first"), F.element_at(spans, -1)["b"].alias("last_end"))


@_query("grep_highlight", "SELECT idx, regexp_replace(s_seq, '(GATTAC)', concat(chr(27), '[31;1m', '\\1', chr(27), '[0m'), 'g') AS s_seq FROM reads WHERE contains(s_seq, 'GATTAC')")
def _(df):
    return grep.highlighted(df, search(primary=["GATTAC"])).select("idx", "s_seq")


@_query("decode_fasta", "SELECT idx, CAST(1 AS INTEGER) AS mate, concat('>', s_header, chr(10), s_seq) AS record FROM reads")
def _(df):
    return transform.decode(df, "fasta", "1")


@_query("decode_fastq_fill", "SELECT idx, CAST(2 AS INTEGER) AS mate, concat('@', x_header, chr(10), x_seq, chr(10), '+', chr(10), repeat('?', length(x_seq))) AS record FROM reads")
def _(df):
    return transform.decode(df.withColumn("x_qual", F.lit(None).cast("string")), "fastq", "2")


@_query("decode_fastq", "SELECT idx, CAST(1 AS INTEGER) AS mate, concat('@', s_header, chr(10), s_seq, chr(10), '+', chr(10), s_qual) AS record FROM reads")
def _(df):
    return transform.decode(df, "fastq", "1")


@_query("decode_tsv", "SELECT idx, CAST(1 AS INTEGER) AS mate, concat(s_header, chr(9), s_seq) AS record FROM reads")
def _(df):
    return transform.decode(df, "tsv", "1")


@_query(
    "decode_mate_interleave",
    """SELECT idx, CAST(mate AS INTEGER) AS mate, record FROM (
         SELECT idx, 1 AS mate, concat(s_header, chr(9), s_seq) AS record FROM reads
         UNION ALL SELECT idx, 2, concat(x_header, chr(9), x_seq) FROM reads WHERE idx % 3 <> 0) u""",
)
def _(df):
    return transform.decode(df.withColumn("x_seq", F.when(F.col("idx") % 3 == 0, "").otherwise(F.col("x_seq"))), "tsv", "both")


@_query("span_slice", "SELECT idx, s_seq FROM reads WHERE idx >= 1000 AND idx < 2500")
def _(df):
    return in_span(df, Span(1000, 2500)).select("idx", "s_seq")


_RC = "reverse(translate({0}_seq, 'ACGTacgt', 'TGCAtgca')) AS {0}_seq, reverse({0}_qual) AS {0}_qual"


@_query("revcomp_both", f"SELECT idx, s_header, {_RC.format('s')}, {_RC.format('x')} FROM reads")
def _(df):
    return transform.revcomp(df).select("idx", "s_header", "s_seq", "s_qual", "x_seq", "x_qual")


@_query("revcomp_mate2", f"SELECT idx, s_seq, {_RC.format('x')} FROM reads")
def _(df):
    return transform.revcomp(df, "2").select("idx", "s_seq", "x_seq", "x_qual")


@_query("npolicy_a", "SELECT idx, replace(s_seq, 'N', 'A') AS s_seq, x_seq FROM reads")
def _(df):
    return transform.n_policy(df, "a").select("idx", "s_seq", "x_seq")


@_query("npolicy_ignore", "SELECT idx, s_seq, x_seq FROM reads WHERE NOT contains(s_seq, 'N') AND NOT contains(x_seq, 'N')")
def _(df):
    return transform.n_policy(df, "i").select("idx", "s_seq", "x_seq")


@_query("npolicy_random")
def _(df):
    return transform.n_policy(df, "r").select("idx", "s_seq", "x_seq")


_DRAW = f"(((idx + 42) * {fn.STEP_A}) % {fn.PRIME} * {fn.STEP_B}) % {fn.PRIME}"


@_query("sample_fraction", f"SELECT idx, s_seq FROM reads WHERE CAST({_DRAW} AS DOUBLE) < 0.1 * {fn.PRIME}")
def _(df):
    return transform.sample_fraction(df, 0.1).select("idx", "s_seq")


@_query("sample_exact", f"SELECT idx, s_seq FROM reads ORDER BY {_DRAW}, idx LIMIT 1000")
def _(df):
    return transform.sample_number(df, 1000).select("idx", "s_seq")


@_query("cat_union", "SELECT idx, s_seq FROM reads UNION ALL SELECT idx + (SELECT count(*) FROM reads), x_seq FROM reads")
def _(df):
    second = df.withColumn("s_seq", F.col("x_seq"))
    return combine.cat([ReadSet(df, Meta(paired=True)), ReadSet(second, Meta(paired=True))]).df.select("idx", "s_seq")


_ALIASES = [Pattern("GATTA", name="one"), Pattern("CCCGG", name="two"), Pattern("ACGTAC", name="one"), Pattern("TTTTTTTTTTTTTTT", name="rare")]
_ROUTES = f"""
routes AS (
  SELECT idx, CASE WHEN a + b + c <> 1 THEN 'unmatched' WHEN a = 1 THEN 'one' WHEN b = 1 THEN 'two' ELSE 'rare' END AS alias
  FROM (SELECT idx, CAST({_e('GATTA')} OR {_e('ACGTAC')} AS INTEGER) AS a, CAST({_e('CCCGG')} AS INTEGER) AS b, CAST({_e('TTTTTTTTTTTTTTT')} AS INTEGER) AS c FROM reads) h
)"""


def _split() -> object:
    return search(files=_ALIASES)


@_query("split_route", f", {_ROUTES} SELECT idx, alias FROM routes")
def _(df):
    return combine.routed(df, _split()).select("idx", "alias")


@_query("split_tally", f", {_ROUTES} SELECT a.alias, CAST(count(r.idx) AS BIGINT) AS count FROM (VALUES ('one'), ('two'), ('rare'), ('unmatched')) a(alias) LEFT JOIN routes r ON r.alias = a.alias GROUP BY a.alias")
def _(df):
    return combine.tallies(df, _split())


@_query("split_min_records", f", {_ROUTES} SELECT idx, alias FROM routes WHERE alias <> 'unmatched' AND alias IN (SELECT alias FROM routes GROUP BY alias HAVING count(*) >= 10)")
def _(df):
    return combine.split(df, _split(), 10, skip_unmatched=True).select("idx", "alias")


@_query(
    "shard_ranges",
    "SELECT CAST(shard AS INTEGER) AS shard, min(idx) AS first, max(idx) AS last, CAST(count(*) AS BIGINT) AS n FROM (SELECT idx, least((idx - 10) // ((SELECT count(*) - 10 FROM reads) // 7), 6) AS shard FROM reads WHERE idx >= 10) s GROUP BY shard",
)
def _(df):
    start, end = Span(10).resolve(df.count())
    out = transform.shards(df, 7, start, end)
    return out.groupBy("shard").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))


_AT = "(SELECT unnest(range(1, 65)) AS p) p"


@_query(
    "qc_base_quality",
    f"SELECT CAST(p - 1 AS INTEGER) AS pos, CAST(least(greatest(ascii(substring(s_qual, CAST(p AS INTEGER), 1)) - 33, 0), 93) AS INTEGER) AS qual, CAST(count(*) AS BIGINT) AS count FROM reads, {_AT} WHERE p <= length(s_qual) GROUP BY 1, 2",
)
def _(df):
    return qc.base_quality(df)


_CONTENT = "SELECT pos, " + ", ".join(f"CAST({b} AS BIGINT) AS {b}" for b in "acgtn") + ", " + ", ".join(f"{b} / total * 100 AS pct_{b}" for b in "acgtn") + " FROM ("


@_query(
    "qc_base_content",
    _CONTENT + "SELECT CAST(p - 1 AS INTEGER) AS pos, count(*) AS total, " + ", ".join(f"count(*) FILTER (b = '{x}') AS {x.lower()}" for x in "ACGT") + ", count(*) FILTER (b NOT IN ('A', 'C', 'G', 'T')) AS n "
    f"FROM (SELECT p, upper(substring(s_seq, CAST(p AS INTEGER), 1)) AS b FROM reads, {_AT} WHERE p <= length(s_seq)) u GROUP BY p) c",
)
def _(df):
    return qc.base_content(df)


_MEAN = "CAST(least(round(CAST(list_sum(list_transform(string_split(s_qual, ''), lambda c: least(greatest(ascii(c) - 33, 0), 255))) AS DOUBLE) / length(s_qual)), 93) AS INTEGER)"


@_query("qc_seq_quality", f"SELECT CAST(v AS INTEGER) AS qual, CAST(count(q) AS BIGINT) AS count FROM (SELECT unnest(range(0, 94)) AS v) r LEFT JOIN (SELECT {_MEAN} AS q FROM reads WHERE length(s_qual) > 0) m ON q = v GROUP BY v")
def _(df):
    return qc.seq_quality(df)


_GC = "CAST(round(CAST(length(regexp_replace({0}_seq, '[^GCgc]', '', 'g')) AS DOUBLE) / length({0}_seq) * 100) AS INTEGER)"


@_query("qc_gc_content", f"SELECT CAST(v AS INTEGER) AS pct_gc, CAST(count(g) AS BIGINT) AS count FROM (SELECT unnest(range(0, 101)) AS v) r LEFT JOIN (SELECT {_GC.format('s')} AS g FROM reads WHERE length(s_seq) > 0) m ON g = v GROUP BY v")
def _(df):
    return qc.gc_content(df)


@_query("qc_seq_length", "SELECT CAST(length(s_seq) AS INTEGER) AS len, CAST(count(*) AS BIGINT) AS count FROM reads WHERE length(s_seq) > 0 GROUP BY 1")
def _(df):
    return qc.seq_length(df)


_DUPS = "dups AS (SELECT s_seq AS sequence, count(*) AS count FROM reads WHERE length(s_seq) > 0 GROUP BY 1)"
_LEVELS = ", ".join(f"({k}, {least}, '{label}')" for k, (least, label) in enumerate(qc.LEVELS))


@_query(
    "qc_dup_levels",
    f""", {_DUPS}, levels AS (SELECT * FROM (VALUES {_LEVELS}) l(k, least, level)),
    by_level AS (SELECT k, count(*) AS d, sum(count) AS t FROM (SELECT count, (SELECT max(k) FROM levels WHERE least <= count) AS k FROM dups) x GROUP BY k)
    SELECT level, CAST(coalesce(d, 0) AS BIGINT) AS distinct_count, coalesce(d, 0) / (SELECT sum(d) FROM by_level) * 100 AS distinct_pct,
           CAST(coalesce(t, 0) AS BIGINT) AS total_count, coalesce(t, 0) / (SELECT sum(t) FROM by_level) * 100 AS total_pct
    FROM levels LEFT JOIN by_level USING (k)""",
)
def _(df):
    return qc.duplication_levels(qc.sequence_counts(df, sample=0))


@_query("qc_overrepresented", f", {_DUPS} SELECT sequence, CAST(count AS BIGINT) AS count, count / (SELECT sum(count) FROM dups) * 100 AS pct FROM dups WHERE count / (SELECT sum(count) FROM dups) * 100 >= 0.015")
def _(df):
    return qc.overrepresented(qc.sequence_counts(df, sample=0), 0.015)


@_query(
    "qc_stats_gc",
    f""", h AS (SELECT {_GC.format('x')} AS v, count(*) AS c FROM reads GROUP BY 1),
    r AS (SELECT v, c, sum(c) OVER (ORDER BY v) AS cum, sum(c) OVER () AS total FROM h)
    SELECT CAST(max(total) AS BIGINT) AS total, CAST(sum(v * c) AS DOUBLE) / max(total) AS mean, CAST(min(v) FILTER (cum > total // 2) AS INTEGER) AS median,
           (SELECT v FROM h ORDER BY c DESC, v DESC LIMIT 1) AS mode FROM r""",
)
def _(df):
    return qc.histogram_stats(qc.gc_content(df, "x"), "pct_gc")


@_query(
    "qc_headline_quality",
    f""", m AS (SELECT p - 1 AS pos, sum(q) AS w, count(*) AS n, CAST(sum(q) AS DOUBLE) / count(*) AS m
            FROM (SELECT p, least(greatest(ascii(substring(x_qual, CAST(p AS INTEGER), 1)) - 33, 0), 93) AS q FROM reads, {_AT} WHERE p <= length(x_qual)) u GROUP BY p)
    SELECT CAST(count(*) AS BIGINT) AS positions, CAST(sum(w) AS DOUBLE) / sum(n) AS mean, min(m) AS lowest, CAST((SELECT pos FROM m ORDER BY m, pos LIMIT 1) AS INTEGER) AS lowest_pos,
           max(m) AS highest, CAST((SELECT pos FROM m ORDER BY m DESC, pos DESC LIMIT 1) AS INTEGER) AS highest_pos FROM m""",
)
def _(df):
    return qc.quality_headline(qc.base_quality(df, "x"))


_FIELDS = ", ".join(f"octet_length(CAST({c} AS BLOB)), ':', {c}" for c in ("s_seq", "s_qual", "s_header", "x_seq", "x_qual", "x_header"))


@_query("verify_md5", f"SELECT CAST(sum(CAST(concat('0x', substring(md5(concat({_FIELDS})), 1, 15)) AS HUGEINT)) AS VARCHAR) AS checksum, CAST(count(*) AS BIGINT) AS n FROM reads")
def _(df):
    return verify.md5_checksum(df)


@_query("verify_xxh3")
def _(df):
    return verify.checksum(df)


@_query("info_counts", "SELECT CAST(count(*) AS BIGINT) AS records, max(length(s_seq)) AS slen_max, max(length(x_seq)) AS xlen_max FROM reads")
def _(df):
    return df.agg(F.count("*").alias("records"), F.max(F.length("s_seq")).cast("long").alias("slen_max"), F.max(F.length("x_seq")).cast("long").alias("xlen_max"))


@_query("pair_files", "SELECT idx, s_header, s_seq, s_qual, x_header, x_seq, x_qual FROM reads")
def _(df):
    one = lambda m: df.select("idx", *[F.col(f"{m}_{c}").alias(c) for c in ("header", "seq", "qual")])
    return combine.zipped(one("s"), one("x"))


@_query("interleave_pivot", "SELECT a.idx // 2 AS idx, a.s_header, a.s_seq, a.s_qual, b.s_header AS x_header, b.s_seq AS x_seq, b.s_qual AS x_qual FROM reads a JOIN reads b ON b.idx = a.idx + 1 WHERE a.idx % 2 = 0")
def _(df):
    return combine.interleaved(df.select("idx", F.col("s_header").alias("header"), F.col("s_seq").alias("seq"), F.col("s_qual").alias("qual")))


@_query(
    "grep_spans_regex",
    """
SELECT idx, array_to_string(list_filter(range(0, length(s_seq) - 3), lambda p: regexp_matches(substring(s_seq, CAST(p + 1 AS INTEGER), 4), '^AC[CT]G$')), ',') AS s_starts,
       array_to_string(list_filter(range(0, length(x_seq) - 3), lambda p: regexp_matches(substring(x_seq, CAST(p + 1 AS INTEGER), 4), '^AC[CT]G$')), ',') AS x_starts
FROM reads WHERE regexp_matches(s_seq, 'AC[CT]G') OR regexp_matches(x_seq, 'AC[CT]G')
""",
)
def _(df):
    starts = lambda c: F.concat_ws(",", F.transform(c, lambda x: x["a"].cast("string")))
    return grep.spans(df, search(["AC[CT]G"])).select("idx", starts("s_spans").alias("s_starts"), starts("x_spans").alias("x_starts"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks can read, as a plain path."""
    path = re.sub("^file:/+", "/", numbering.shared_path(spark, name))
    os.makedirs(path)
    return path


_FULL = "idx, s_header, s_seq, s_qual, x_header, x_seq, x_qual"
_FULL_SQL = f"SELECT {_FULL} FROM reads"
_FIRST, _FIRST_SQL = ("idx", "s_header", "s_seq", "s_qual"), "SELECT idx, s_header, s_seq, s_qual FROM reads"


def _file(name: str, sql: str):
    """A query that writes the reads as files, with a folder of its own, and reads these."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, reads(spark, sf_dir), _folder(spark, name))
        SQL[name] = READS_SQL + sql
        return f

    return add


for _end, _zip in (("fq", None), ("fastq.gz", "gzip"), ("fq.zst", "zstd")):

    @_file(f"file_{_end.replace('.', '_')}", _FIRST_SQL)
    def _(spark, df, folder, end=_end, how=_zip):
        """FASTQ in one file, split by byte ranges where it isn't compressed."""
        sinks.write_file(df, f"{folder}/a.{end}", parse.output_format(f"a.{end}", None), "1", parse.compression(f"a.{end}", None))
        return encode.load(spark, [f"{folder}/a.{end}"], range_bytes=1 << 20).select(*_FIRST)


@_file("file_fasta", "SELECT idx, x_header AS s_header, x_seq AS s_seq, CAST(NULL AS VARCHAR) AS s_qual FROM reads")
def _(spark, df, folder):
    sinks.write_file(df, f"{folder}/a.fa", "fasta", "2")
    return encode.load(spark, [f"{folder}/a.fa"]).select(*_FIRST)


@_file("file_mates", _FULL_SQL)
def _(spark, df, folder):
    """A file for each mate, found in their folder and paired by name."""
    sinks.write_mates(df, f"{folder}/sample", "fastq")
    couples, alone = files.pairs(files.in_directory(folder, 1, True))
    if len(couples) != 1 or alone:
        raise ValueError(f"expected one pair: {couples}, {alone}")
    return encode.load(spark, list(couples[0]), "paired").select(*_FULL.split(", "))


@_file("file_interleaved", _FULL_SQL)
def _(spark, df, folder):
    sinks.write_file(df, f"{folder}/both.fq", "fastq")
    return encode.load(spark, [f"{folder}/both.fq"], "interleaved").select(*_FULL.split(", "))


@_file("file_folder_tsv", "SELECT s_header AS header, s_seq AS seq FROM reads UNION ALL SELECT x_header, x_seq FROM reads")
def _(spark, df, folder):
    sinks.write_folder(df, f"{folder}/tsv", "tsv", compression="gzip")
    cells = F.split("value", "\t")
    return spark.read.text(f"{folder}/tsv").select(F.get(cells, F.lit(0)).alias("header"), F.get(cells, F.lit(1)).alias("seq"))


@_file("file_sam", _FIRST_SQL)
def _(spark, df, folder):
    fields = [F.col("s_header"), F.lit("4"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), F.col("s_seq"), F.col("s_qual")]
    lines = df.select(F.lit(0).alias("part"), "idx", F.lit(1).alias("mate"), F.concat_ws("\t", *fields).alias("record"))
    sinks.write_texts(lines, [f"{folder}/a.sam"], head=b"@HD\tVN:1.6\n")
    return encode.load(spark, [f"{folder}/a.sam"]).select(*_FIRST)


@_file("file_manifest", "SELECT path, records FROM (VALUES ('m.fq', (SELECT count(*) FROM reads)), ('n.fa', (SELECT count(*) FROM reads WHERE idx % 2 = 0)), ('o.fq.gz', (SELECT count(*) FROM reads))) t(path, records)")
def _(spark, df, folder):
    """Files of a manifest encoded one by one; what it lists besides isn't a read file."""
    sinks.write_file(df, f"{folder}/m.fq", "fastq", "1")
    sinks.write_file(df.where("idx % 2 = 0"), f"{folder}/n.fa", "fasta", "2")
    sinks.write_file(df, f"{folder}/o.fq.gz", "fastq", "2", "gzip")
    with open(f"{folder}/list", "w", encoding="utf-8") as f:
        f.write(f"{folder}/m.fq\n\n{folder}/readme.txt\n{folder}/n.fa\n{folder}/o.fq.gz\n")
    listed, skipped = files.in_manifest(f"{folder}/list")
    if skipped != 1:
        raise ValueError(f"{skipped} lines were skipped")
    done = encode.run(spark, encode.plan_jobs(listed, None, "cbq"), Meta())
    by = {parse.encoded_name(x, "cbq"): os.path.basename(x) for x in listed}
    return spark.createDataFrame([(by[path], n["written"]) for path, n in done.items()], "path string, records long")


@_file("encode_counts", "SELECT CAST(count(*) FILTER (NOT contains(s_seq, 'N')) AS BIGINT) AS written, CAST(count(*) FILTER (contains(s_seq, 'N')) AS BIGINT) AS skipped FROM reads")
def _(spark, df, folder):
    sinks.write_file(df, f"{folder}/a.fq", "fastq", "1")
    done = encode.run(spark, encode.plan_jobs([f"{folder}/a.fq"], f"{folder}/a.vbq"), Meta("vbq", bits=2), "i")
    return spark.createDataFrame([(n["written"], n["skipped"]) for n in done.values()], "written long, skipped long")


@_file("set_cbq", _FULL_SQL)
def _(spark, df, folder):
    variants.write_set(df, f"{folder}/a.cbq", Meta("cbq", True))
    return variants.read_set(spark, f"{folder}/a.cbq").df.select(*_FULL.split(", "))


@_file("set_vbq", "SELECT idx, s_header, replace(s_seq, 'N', 'C') AS s_seq, x_header, x_seq FROM reads")
def _(spark, df, folder):
    variants.write_set(df, f"{folder}/a.vbq", Meta("vbq", True, quality=False, bits=2, compressed=False), "c")
    return variants.read_set(spark, f"{folder}/a.vbq").df


@_file("set_bq", "SELECT idx, substring(s_seq, 1, 40) AS s_seq, x_seq FROM reads")
def _(spark, df, folder):
    variants.write_set(df.withColumn("s_seq", F.substring("s_seq", 1, 40)), f"{folder}/a.bq", Meta("bq", True))
    return variants.read_set(spark, f"{folder}/a.bq").df


@_file("set_info", "SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS in_blocks, true AS paired, 'vbq' AS variant FROM reads")
def _(spark, df, folder):
    variants.write_set(df, f"{folder}/a.vbq", Meta("vbq", True))
    x = variants.info(f"{folder}/a.vbq", index=True)
    return spark.createDataFrame([(x["records"], sum(b["records"] for b in x["index"]), x["paired"], x["variant"])], "records long, in_blocks long, paired boolean, variant string")


@_file("set_lengths", "SELECT CAST(length(s_seq) AS BIGINT) AS slen, CAST(length(x_seq) AS BIGINT) AS xlen FROM reads WHERE idx = 0")
def _(spark, df, folder):
    return spark.createDataFrame([variants.lengths(df)], "slen long, xlen long")


@_file("sample_to_set", "SELECT idx, s_seq, x_seq FROM reads")
def _(spark, df, folder):
    """A share of 1 into a set of the same variant."""
    variants.write_set(transform.sample_fraction(df, 1.0, 7), f"{folder}/a.cbq", Meta("cbq", True))
    return variants.read_set(spark, f"{folder}/a.cbq").df.select("idx", "s_seq", "x_seq")


@_file("pattern_file", f"SELECT idx, s_seq, x_seq FROM reads WHERE {_e('GATTAC')} OR {_e('CCCCC')} OR contains(s_seq, 'TTTTT')")
def _(spark, df, folder):
    for name, text in (("a.fa", ">one\nGAT\nTAC\n>two\nCCCCC\n"), ("b.tsv", "p\tTTTTT\n")):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    given = [*patterns.load(f"{folder}/a.fa"), *patterns.load(f"{folder}/b.tsv", "primary")]
    return grep.matching(df, search(files=given)).select("idx", "s_seq", "x_seq")


@_file("pipe_shards", "SELECT CAST(least(idx // (n // 3), 2) AS INTEGER) AS shard, CAST(count(*) AS VARCHAR) AS output FROM (SELECT idx, count(*) OVER () AS n FROM reads) t GROUP BY 1")
def _(spark, df, folder):
    found = pipe.per_shard(df.select(*_FIRST), "cat {} | wc -l", 3, "tsv")
    return found.select("shard", F.trim(F.regexp_replace("output", "\n", "")).alias("output"))


@_file("pipe_once", "SELECT CAST(2 * count(*) AS VARCHAR) AS output FROM reads")
def _(spark, df, folder):
    done = pipe.once(df, "cat {R1} {R2} | wc -l", 4, folder, "tsv")
    return spark.createDataFrame([(done.stdout.strip(),)], "output string")


@_file("pipe_readers", "SELECT s_header AS header, s_seq AS seq FROM reads")
def _(spark, df, folder):
    """Named pipes with a reader each, here threads; what they get, stored."""
    def read(path):
        with open(path, "rb") as f, open(f"{path}.txt", "wb") as to:
            shutil.copyfileobj(f, to)

    with pipe.Pipes(df.select(*_FIRST), 2, f"{folder}/p", "tsv") as made:
        readers = [threading.Thread(target=read, args=(path,)) for path in made.paths.values()]
        for t in readers:
            t.start()
        made.wait()
        for t in readers:
            t.join()
    cells = F.split("value", "\t")
    return spark.read.text([f"{x}.txt" for x in made.paths.values()]).select(F.get(cells, F.lit(0)).alias("header"), F.get(cells, F.lit(1)).alias("seq"))


def documents_header_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header search over texts with letters of several bytes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = d.select(F.col("doc_id").alias("idx"), F.col("text").alias("s_header"), F.lit("A").alias("s_seq"))
    return grep.matching(own, search(["é[a-z]+ión|ß"], header=True)).select("idx", F.length("s_header").cast("long").alias("n"))


QUERIES["documents_header_regex"] = documents_header_regex
SQL["documents_header_regex"] = "SELECT doc_id AS idx, CAST(length(text) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, 'é[a-z]+ión|ß')"

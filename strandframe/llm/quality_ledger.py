"""Quality rules as a ledger of bitmasks, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
integer, ``fail_bits``, with bit k set if rule k fails. A policy is a named set of
rules, so a mask: a document passes if ``fail_bits & mask`` is zero. Another policy,
or leaving out one rule, needs the ledger only, not the texts.

All measurements of a text are taken in its own row: nothing is shuffled.

Words are runs without the code points 0x20 and 0x09 to 0x0D. A null text has no
words. A word counts as repeated if it lies in a window of three words that is found
twice or more in the text; windows are held against each other by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import ASCII_SPACE, fresh

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")

#: Name and failing condition of each rule, over the measurements; the place is the bit. Rules are only ever added at the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "10 * n_marks > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 7 * n_lines"),
    ("word_length_low", "word_chars < 2 * n_words"),
    ("word_length_high", "word_chars > 20 * n_words"),
)

#: Versioned policies. ``base`` decides base_failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "shouting"),
    "strict": tuple(name for name, _ in RULES),
}


def mask(rules: Iterable[str]) -> int:
    bits = {name: 1 << k for k, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in set(rules))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row; repeated rows stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"{ASCII_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wide = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    # A lambda's body is evaluated for each element, so arrays that it needs are bound by an outer transform.
    windows = "CASE WHEN size(words) < 3 THEN array() ELSE transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i)) END"
    repeats = "filter(s, (x, j) -> (j > 0 AND s[j - 1].h = x.h) OR (j < size(s) - 1 AND s[j + 1].h = x.h))"
    places = f"transform(array(sort_array({windows})), s -> sort_array(transform({repeats}, x -> x.i)))[0]"
    covered = f"aggregate({places}, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)"
    taken = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_marks"),
    )
    # A generated row is taken as it is: filters above don't repeat the expressions below.
    return wide.select("doc_id", F.inline(F.array(taken)))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs).withColumn("fail_bits", total.cast("long"))


def passes(policy: str, fail_bits: Column | str = "fail_bits") -> Column:
    bits = F.col(fail_bits) if isinstance(fail_bits, str) else fail_bits
    return bits.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def verdicts(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept; what fails the base policy is never kept."""
    return ledger(docs).withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def ablations(of: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy, from a ledger: rows that fail it, fail it alone, and pass without it.

    One aggregation over the distinct masks, of which there are at most 2**rules.
    """
    own = mask(POLICIES[policy])
    by_mask = of.groupBy(F.col("fail_bits").bitwiseAND(F.lit(own)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).alias("bit")) for name in POLICIES[policy]])
    each = by_mask.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    rest = F.col("bits").bitwiseAND(F.lit(own).bitwiseXOR(F.col("bit")))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        count(F.col("bits") == F.col("bit"))("n_failed_alone"),
        count(rest == 0)("n_passed_without"),
    )


def kept_documents(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; each row is judged by itself, so nothing is joined."""
    name = fresh(docs, "_text_kept")
    judged = docs.withColumn(name, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    inner = judged.select(F.col(name).alias("doc_id"), F.col("text"))
    return verdicts(inner, policy).where("kept").select("doc_id.*")


_MEASURED_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w) u
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) g WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) x GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_marks
  FROM w LEFT JOIN repeats r ON r.doc_id = w.doc_id
)"""


def _ledger_sql() -> str:
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    return f"{_MEASURED_SQL}, l AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)"


def verdict_sql(policy: str = "v1") -> str:
    """``verdicts`` as SQL, without the measurements that only rules use."""
    base, own = mask(POLICIES["base"]), mask(POLICIES[policy])
    return f"""{_ledger_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {base} <> 0 AS base_failed, fail_bits & {base | own} = 0 AS kept, fail_bits
FROM l
"""


def ablation_sql(policy: str = "v1") -> str:
    """``ablations`` as SQL."""
    own = mask(POLICIES[policy])
    each = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, count(*) FILTER (fail_bits & {mask([name])} <> 0) AS n_failed, count(*) FILTER (fail_bits & {own} = {mask([name])}) AS n_failed_alone, count(*) FILTER (fail_bits & {own ^ mask([name])} = 0) AS n_passed_without FROM l"
        for name in POLICIES[policy]
    )
    return f"{_ledger_sql()}\n{each}\n"

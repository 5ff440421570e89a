"""Column functions over sequences and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.plans.parse import Range

#: Fixed values of the sampling generator (Lehmer steps modulo a Mersenne prime).
PRIME, STEP_A, STEP_B = 2147483647, 48271, 69621
MOST_QUALITY, OFFSET = 93, 33


def reverse_complement(seq: Column) -> Column:
    """Bases keep their case; other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def cut(seq: Column, within: Range) -> Column:
    if within.full:
        return seq
    length = F.length(seq) if within.end is None else F.lit(max(0, within.end - within.start))
    return F.substring(seq, F.lit(within.start + 1), length)


def filled_quality(qual: Column, seq: Column) -> Column:
    """The quality cut to the sequence's length, or question marks."""
    return F.coalesce(F.substring(qual, F.lit(1), F.length(seq)), F.repeat(F.lit("?"), F.length(seq)))


def gc_percent(seq: Column) -> Column:
    """Rounded percentage of G and C in either case; null for an empty sequence. The order of the operations matters for halves."""
    gc = F.length(seq) - F.length(F.translate(seq, "GCgc", ""))
    return F.when(F.length(seq) > 0, F.round(gc.cast("double") / F.length(seq) * 100).cast("int"))


def ratio(n: Column, total: Column) -> Column:
    """n / total, and 0 where total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(n.cast("double") / F.nullif(total, F.lit(0)))


def draw(idx: Column, seed: int) -> Column:
    """A number from 0 to PRIME - 1 that depends on index and seed only."""
    return (((idx + F.lit(seed)) * STEP_A) % PRIME * STEP_B) % PRIME


def sampled(idx: Column, fraction: float, seed: int) -> Column:
    return draw(idx, seed).cast("double") < F.lit(float(fraction) * PRIME)


def random_bases(seq: Column, idx: Column, seed: int) -> Column:
    """Each N replaced by a base that depends on index, place and seed."""
    letters = F.transform(
        F.split(seq, ""),
        lambda c, i: F.when(c == "N", F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64(idx, i, F.lit(seed)), F.lit(4)) + 1).cast("int"), F.lit(1))).otherwise(c),
    )
    return F.when(F.contains(seq, F.lit("N")), F.array_join(letters, "")).otherwise(seq)


def merged_spans(spans: Column) -> Column:
    """Sorted spans (a, b) of an array, those that overlap or touch made one."""
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["a"] <= F.get(acc, F.size(acc) - 1)["b"])
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, step)


def highlighted(text: Column, spans: Column) -> Column:
    """The text with merged spans wrapped in the terminal's codes for bold red."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        plain = F.substring(text, acc["at"] + 1, s["a"] - acc["at"])
        red = F.concat(F.lit("\x1b[31;1m"), F.substring(text, s["a"] + 1, s["b"] - s["a"]), F.lit("\x1b[0m"))
        return F.struct(F.concat(acc["out"], plain, red).alias("out"), s["b"].alias("at"))

    return F.aggregate(merged_spans(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def fixed_spans(seq: Column, literal: str, shift: int = 0) -> Column:
    """All places of a literal, overlapping ones too, as spans (a, b)."""
    n = len(literal)
    places = F.when(F.length(seq) >= n, F.sequence(F.lit(0), F.length(seq) - n)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.substring(seq, i + 1, F.lit(n)) == F.lit(literal))
    return F.transform(found, lambda i: F.struct((i + shift).alias("a"), (i + shift + n).alias("b")))

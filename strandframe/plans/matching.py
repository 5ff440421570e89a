"""From patterns and flags to predicates.

The plan is made on the driver: patterns are checked, complemented and dealt to the
mates, a backend is chosen, and each pattern becomes a Column. Literals become
``contains``, never regular expressions, so that the scan stays in generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import seq as fn
from strandframe.functions.fuzzy import Fuzzy, fuzzy_any
from strandframe.plans.parse import Range, Span
from strandframe.sources.patterns import SCOPES, Pattern


@dataclass(frozen=True)
class Search:
    """What to look for, and how. mate: 1, 2 or both. logic: and, or."""

    patterns: tuple[Pattern, ...]
    logic: str = "and"
    invert: bool = False
    header: bool = False
    fixed: bool = False
    fuzzy: Fuzzy | None = None
    rc: bool = False
    mate: str = "both"
    within: Range = field(default_factory=Range)
    span: Span = field(default_factory=Span)

    def __post_init__(self):
        if self.header and (self.rc or self.fuzzy or not self.within.full):
            raise ValueError("headers can't be searched with rc, fuzzy or a range")
        if self.mate not in ("1", "2", "both") or self.logic not in ("and", "or"):
            raise ValueError("mate is 1, 2 or both; logic is and or or")


def search(either=(), primary=(), extended=(), files=(), **flags) -> Search:
    """A search of pattern texts and of patterns from files. Files force or-logic. Patterns are ordered by scope, texts first."""
    given = [Pattern(x, s) for s, xs in zip(SCOPES, (primary, extended, either), strict=True) for x in xs]
    ordered = tuple(p for s in SCOPES for p in [*(g for g in given if g.scope == s), *(f for f in files if f.scope == s)])
    if files:
        flags["logic"] = "or"
    return Search(ordered, **flags)


def complemented(p: Pattern) -> Pattern:
    if not re.fullmatch("[ACGT]+", p.text):
        raise ValueError(f"only ACGT has a reverse complement: {p.text!r}")
    return replace(p, text=p.text[::-1].translate(str.maketrans("ACGT", "TGCA")))


#: Bracketed class names and what they are in Java.
POSIX = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "0-9", "graph": "\\p{Graph}", "lower": "a-z",
    "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\t\\n\\x0B\\f\\r ", "upper": "A-Z", "word": "\\w", "xdigit": "\\p{XDigit}",
}
_PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)(?:(sc|scx|script|gc)=)?([A-Za-z_ ]+)\}|([A-Z]))")


def _property(found: re.Match) -> str:
    """A Unicode class: categories have one or two letters, everything else is a script or binary property."""
    letter, caret, kind, name, short = found.groups()
    name = short or name
    if caret:
        letter = "P" if letter == "p" else "p"
    plain = kind == "gc" or (kind is None and len(name) <= 2)
    return f"\\{letter}{{{name if plain else 'Is' + name}}}"


def java_regex(text: str) -> str:
    """A linear-time expression in Java's syntax. What such engines don't have is refused; ``$`` matches at the very end only.

    Search and hit places both use the result. Java's engine backtracks, so nested
    repetitions can still be slow.
    """
    out, i, in_class = [], 0, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if found := _PROPERTY.match(text, i):
                out.append(_property(found))
                i = found.end()
                continue
            if i + 1 < len(text) and (text[i + 1].isdigit() or text[i + 1] in "kGZQEXRNhHVcek"):
                raise ValueError(f"back references and the like aren't supported: {text!r}")
            out.append("\\x0B" if text[i : i + 2] == "\\v" else text[i : i + 2])
            i += 2
            continue
        if in_class:
            if found := re.compile(r"\[:(\^?)([a-z]+):\]").match(text, i):
                if found[2] not in POSIX:
                    raise ValueError(f"unknown class {found[0]!r}: {text!r}")
                out.append(f"[^{POSIX[found[2]]}]" if found[1] else POSIX[found[2]])
                i = found.end()
                continue
            if text.startswith(("--", "~~"), i):
                raise ValueError(f"differences of classes aren't supported: {text!r}")
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            opened = re.compile(r"\[\^?\]?").match(text, i)[0]  # a bracket right behind stands for itself
            out.append(opened.replace("]", "\\]"))
            i += len(opened)
            continue
        elif text.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>", "(?P=", "(?P>"), i):
            raise ValueError(f"look-around and references aren't supported: {text!r}")
        elif text.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        elif c in "*+?}" and text[i + 1 : i + 2] == "+":
            raise ValueError(f"possessive repetition isn't supported: {text!r}")
        elif c == "$":
            c = "\\z"
        out.append(c)
        i += 1
    made = "".join(out)
    context = SparkContext._active_spark_context
    if context is not None:  # the engine that will run it says whether it is one
        try:
            context._jvm.java.util.regex.Pattern.compile(made)
        except (Py4JJavaError, PySparkException) as e:
            raise ValueError(f"not a regular expression: {text!r}: {e}") from e
    return made


@dataclass(frozen=True)
class Plan:
    """Checked patterns with their backend: fixed, regex or fuzzy."""

    search: Search
    patterns: tuple[Pattern, ...]
    backend: str
    paired: bool

    def _one(self, column: Column, text: str) -> Column:
        if self.backend == "fixed":
            found = F.contains(column, F.lit(text))
        elif self.backend == "regex":
            found = column.rlike(java_regex(text))
        else:
            found = fuzzy_any(column, text, self.search.fuzzy)
        return (F.length(column) > 0) & found

    def sequence(self, mate: str) -> Column:
        """What is searched in a mate; null counts as empty."""
        name = f"{mate}_header" if self.search.header else f"{mate}_seq"
        return F.coalesce(fn.cut(F.col(name), self.search.within), F.lit(""))

    def mates(self, scope: str) -> list[str]:
        wanted = {"primary": ["s"], "extended": ["x"], "either": ["s", "x"]}[scope]
        return [m for m in wanted if m == "s" or self.paired]

    def hits(self) -> list[Column]:
        """For each pattern, whether a read has it in its scope."""
        return [reduce(Column.__or__, [self._one(self.sequence(m), p.text) for m in self.mates(p.scope)]) for p in self.patterns]

    def predicate(self) -> Column:
        join = Column.__and__ if self.search.logic == "and" else Column.__or__
        found = reduce(join, self.hits())
        return ~found if self.search.invert else found


def plan(s: Search, paired: bool) -> Plan:
    patterns = s.patterns
    if s.rc:
        patterns = tuple(complemented(p) for p in patterns)
    if not paired and any(p.scope == "extended" for p in patterns):
        raise ValueError("extended patterns need paired reads")
    if paired and s.mate != "both":
        kept = "primary" if s.mate == "1" else "extended"
        own = [p for p in patterns if p.scope == kept]
        patterns = tuple([*own, *(replace(p, scope=kept) for p in patterns if p.scope == "either")])
    if not patterns:
        raise ValueError("there is no pattern to look for")
    if s.fuzzy:
        backend = "fuzzy"
        for scope in SCOPES:
            if len({len(p.text) for p in patterns if p.scope == scope}) > 1:
                raise ValueError("fuzzy patterns of a set must have one length")
    elif s.fixed or all(re.fullmatch("[ACGT]+", p.text) for p in patterns):
        backend = "fixed"
    else:
        backend = "regex"
        for p in patterns:
            java_regex(p.text)
    return Plan(s, patterns, backend, paired)


def in_span(df: DataFrame, span: Span) -> DataFrame:
    """Rows of a span. Both bounds are pushed to the scan; the number of rows isn't needed unless the start has to be checked."""
    if span.start:
        df = df.where(F.col("idx") >= span.start)
    if span.end is not None:
        df = df.where(F.col("idx") < span.end)
    return df


def checked_span(df: DataFrame, span: Span) -> DataFrame:
    """Like ``in_span``, after making sure that the span starts within the rows."""
    if span.start:
        span.resolve(df.count())
    return in_span(df, span)

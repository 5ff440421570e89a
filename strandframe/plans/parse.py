"""Small texts of options: spans, ranges, sizes, fractions, formats and names."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Extension to text format.
FORMATS = {"fa": "fasta", "fasta": "fasta", "fq": "fastq", "fastq": "fastq", "tsv": "tsv", "txt": "tsv", "sam": "sam", "bam": "bam", "cram": "cram"}
#: Extensions that batch encoding finds.
READ_FILE = re.compile(r"\.(fastq|fq|fasta|fa)(\.gz|\.zst)?$")
MATE_FILE = re.compile(r"^(?P<base>.*)_R(?P<mate>[12])(?P<suffix>(_[^.]*)?\.(fastq|fq|fasta|fa)(\.gz|\.zst)?)$")


@dataclass(frozen=True)
class Span:
    """Records from ``start`` up to, not including, ``end``; None is open."""

    start: int | None = None
    end: int | None = None

    def resolve(self, n: int) -> tuple[int, int]:
        """Bounds among n records: a start behind the last is an error, an end behind it is cut, a reversed span is empty."""
        start, end = self.start or 0, n if self.end is None else min(self.end, n)
        if start > n:
            raise ValueError(f"span starts at {start}, but there are {n} records")
        return start, max(start, end)


def _bounds(text: str) -> tuple[int | None, int | None]:
    found = re.fullmatch(r"\s*(\d*)\s*\.\.\s*(\d*)\s*", text)
    if not found:
        raise ValueError(f"expected A..B, got {text!r}")
    a, b = (int(x) if x else None for x in found.groups())
    return a, b


def span(text: str | None) -> Span:
    return Span(*_bounds(text)) if text else Span()


@dataclass(frozen=True)
class Range:
    """Bases from ``start`` up to ``end`` of a sequence, both cut to its length."""

    start: int = 0
    end: int | None = None

    @property
    def full(self) -> bool:
        return not self.start and self.end is None


def base_range(text: str | None) -> Range:
    if not text:
        return Range()
    a, b = _bounds(text)
    if a is not None and b is not None and a > b:
        raise ValueError(f"range starts behind its end: {text!r}")
    return Range(a or 0, b)


def memory_size(text: str) -> int:
    """Bytes of ``64``, ``128K``, ``200M`` or ``1G``."""
    found = re.fullmatch(r"(\d+)\s*([kKmMgG]?)[bB]?", text.strip())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2].lower()]


def number_between(text: str | float, low: float, high: float, open_low: bool = False) -> float:
    value = float(text)
    if not (low < value if open_low else low <= value) or not value <= high:
        raise ValueError(f"{value} isn't between {low} and {high}")
    return value


def sample_fraction(text: str | float) -> float:
    return number_between(text, 0.0, 1.0, open_low=True)


def n_fraction(text: str | float) -> float:
    return number_between(text, 0.0, 1.0)


def percentage(text: str | float) -> float:
    return number_between(text, 0.0, 100.0)


def _split_name(path: str) -> tuple[str, str | None]:
    """The path without a compression suffix, and the compression."""
    for suffix, kind in ((".gz", "gzip"), (".zst", "zstd")):
        if path.lower().endswith(suffix):
            return path[: -len(suffix)], kind
    return path, None


def output_format(path: str | None, given: str | None = None) -> str:
    """Given format, else that of the extension, else TSV without a path."""
    if given:
        kind = {"a": "fasta", "q": "fastq", "t": "tsv", "b": "bam"}.get(given, given)
    elif path is None:
        kind = "tsv"
    else:
        stem = _split_name(path)[0]
        kind = FORMATS.get(stem.rpartition(".")[2].lower() if "." in stem.rpartition("/")[2] else "")
        if kind is None:
            raise ValueError(f"can't tell the format of {path!r}")
    if kind in ("bam", "sam", "cram"):
        raise ValueError(f"{kind} output isn't supported")
    if kind not in ("fasta", "fastq", "tsv"):
        raise ValueError(f"unknown format {kind!r}")
    return kind


def compression(path: str | None, given: str | None = None) -> str | None:
    """None, gzip or zstd: given (u, g, z), else that of the suffix."""
    if given:
        kinds = {"u": None, "g": "gzip", "z": "zstd"}
        if given not in kinds:
            raise ValueError(f"unknown compression {given!r}")
        return kinds[given]
    return _split_name(path)[1] if path else None


def input_format(paths: list[str], given: str | None = None) -> str:
    """fastx, or sam for one path with such an extension."""
    if given:
        kinds = {"a": "fastx", "q": "fastx", "b": "sam"}
        if given not in kinds:
            raise ValueError(f"unknown format {given!r}")
        return kinds[given]
    if len(paths) == 1 and paths[0].lower().endswith((".sam", ".bam", ".cram")):
        return "sam"
    return "fastx"


def variant_of(path: str) -> str | None:
    end = path.rstrip("/").rpartition(".")[2].lower()
    return end if end in ("bq", "vbq", "cbq") else None


def output_variant(path: str | None, given: str | None = None, inherited: str | None = None) -> str:
    """Given variant, else the extension's, else the inherited one, else cbq; an extension must not contradict an inherited one."""
    named = variant_of(path) if path else None
    if inherited and named and named != inherited:
        raise ValueError(f"the input is {inherited}, the output's name says {named}")
    return given or named or inherited or "cbq"


def encoded_name(path: str, variant: str, paired: bool = False) -> str:
    """Name of the encoded output of a read file: its extension is swapped, of pairs the mate's mark goes, too."""
    found = MATE_FILE.search(path) if paired else None
    if found:
        stem = found["base"] + READ_FILE.sub("", found["suffix"])
        return f"{stem}.{variant}"
    out = READ_FILE.sub(f".{variant}", path)
    if out == path:
        raise ValueError(f"can't name an output for {path!r}")
    return out


def pair_names(paths: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """(R1, R2) by base and suffix, sorted by R1, and the files without a partner."""
    mates: dict[tuple[str, str], dict[str, str]] = {}
    loose = []
    for p in paths:
        found = MATE_FILE.match(p)
        if found:
            mates.setdefault((found["base"], found["suffix"]), {})[found["mate"]] = p
        else:
            loose.append(p)
    pairs = sorted((m["1"], m["2"]) for m in mates.values() if len(m) == 2)
    alone = [next(iter(m.values())) for m in mates.values() if len(m) == 1]
    return pairs, sorted([*loose, *alone])

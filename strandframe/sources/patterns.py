"""Pattern files: FASTA, two tab-separated columns, or one pattern a line."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

SCOPES = ("primary", "extended", "either")
#: Rows and letters that decide what a file is.
LOOK = 10


@dataclass(frozen=True)
class Pattern:
    text: str
    scope: str = "either"
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.text if self.name is None else self.name


def _rows(text: str) -> list[list[str]]:
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t") if r]


def parse(text: str, scope: str = "either") -> list[Pattern]:
    """Patterns of a file's text. An empty one holds none."""
    head = text[:LOOK].lstrip("\r\n")
    if head.startswith(">"):
        out, name, parts = [], None, []
        for line in [*text.splitlines(), ">"]:
            if line.startswith(">"):
                if name is not None:
                    out.append(Pattern("".join(parts), scope, name))
                words = line[1:].split()
                name, parts = words[0] if words else "", []
            else:
                parts.append(line.strip())
        return out
    rows = _rows(text)
    if all(len(r) == 2 for r in rows[:LOOK]):
        bad = next((r for r in rows if len(r) != 2), None)
        if bad is not None:
            raise ValueError(f"expected two columns: {bad}")
        return [Pattern(sequence, scope, name) for name, sequence in rows]
    return [Pattern(line.strip(), scope) for line in text.splitlines() if line.strip()]


def load(path: str, scope: str = "either") -> list[Pattern]:
    with open(path, encoding="utf-8", newline="") as f:
        return parse(f.read(), scope)

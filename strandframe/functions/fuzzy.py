"""Approximate search: where a pattern ends in a text within k edits.

A text is read from left to right with one column of the edit-distance table, where
the pattern may start anywhere. Letters are sets of bases (IUPAC), equal if the sets
meet. Of the end places with a cost up to k, those count at which the cost is locally
smallest; of equal neighbours the last. Then matches with too large a share of N go,
and with ``inexact`` those of cost 0.

All texts of a batch are computed side by side, one array operation for each cell of
the column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that a letter stands for, as bits A=1, C=2, G=4, T=8.
IUPAC = {"A": 1, "C": 2, "G": 4, "T": 8, "U": 8, "R": 5, "Y": 10, "S": 6, "W": 9, "K": 12, "M": 3, "B": 14, "D": 13, "H": 11, "V": 7, "N": 15}
_BITS = np.zeros(256, np.uint8)
for _letter, _bits in IUPAC.items():
    _BITS[ord(_letter)] = _BITS[ord(_letter.lower())] = _bits


@dataclass(frozen=True)
class Fuzzy:
    """k edits; share of N in a match, by default k / pattern length up to 1."""

    k: int
    inexact: bool = False
    max_n_frac: float | None = None

    def n_limit(self, pattern: str) -> float:
        return min(self.k / max(1, len(pattern)), 1.0) if self.max_n_frac is None else self.max_n_frac


#: Letters, with what pads them, that are worked on at once.
CELLS = 1 << 21
ROWS = 4096


def groups(texts: list[str]) -> Iterator[list[int]]:
    """Places of all texts, in groups of similar length, so that no padded group is much larger than CELLS or one text."""
    own: list[int] = []
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
        if own and (len(own) == ROWS or (len(own) + 1) * len(texts[k]) > CELLS):
            yield own
            own = []
        own.append(k)
    if own:
        yield own


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, one row each, 0 behind the end, and the lengths."""
    raws = [x.encode("latin-1", "replace") for x in texts]
    lengths = np.array([len(r) for r in raws])
    width = int(lengths.max()) if len(raws) else 0
    out = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), np.uint8).reshape(len(raws), width)
    return out, lengths


def end_costs(letters: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Cost of the best match that ends before each place 0..width, and where that match starts."""
    n, width = letters.shape
    m = len(pattern)
    codes, want = _BITS[letters], [_BITS[ord(c)] if ord(c) < 256 else 0 for c in pattern]
    cost = np.tile(np.arange(m + 1, dtype=np.int32)[:, None], (1, n))
    start = np.zeros((m + 1, n), np.int32)
    costs, starts = np.empty((n, width + 1), np.int32), np.empty((n, width + 1), np.int32)
    costs[:, 0], starts[:, 0] = cost[m], 0
    for j in range(width):
        diagonal, diagonal_start = cost[0].copy(), start[0].copy()
        cost[0], start[0] = 0, j + 1
        for i in range(1, m + 1):
            over, over_start = cost[i].copy(), start[i].copy()
            best = diagonal + ((codes[:, j] & want[i - 1]) == 0)
            at = diagonal_start
            less = over + 1 < best
            best, at = np.where(less, over + 1, best), np.where(less, over_start, at)
            less = cost[i - 1] + 1 < best
            cost[i], start[i] = np.where(less, cost[i - 1] + 1, best), np.where(less, start[i - 1], at)
            diagonal, diagonal_start = over, over_start
        costs[:, j + 1], starts[:, j + 1] = cost[m], start[m]
    return costs, starts


def matches(texts: list[str], pattern: str, how: Fuzzy) -> list[list[tuple[int, int, int]]]:
    """(start, end, cost) of every match in each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if pattern:
        for own in groups(texts):
            for k, found in zip(own, _matches([texts[k] for k in own], pattern, how), strict=True):
                out[k] = found
    return out


def _matches(texts: list[str], pattern: str, how: Fuzzy) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    letters, lengths = padded(texts)
    costs, starts = end_costs(letters, pattern)
    limit = how.n_limit(pattern)
    isn = np.concatenate([np.zeros((len(texts), 1), int), np.cumsum((letters | 32) == ord("n"), axis=1)], axis=1)
    rows = np.flatnonzero((np.where(np.arange(costs.shape[1]) <= lengths[:, None], costs, how.k + 1) <= how.k).any(axis=1))
    for r in rows.tolist():
        line = costs[r, : lengths[r] + 1].tolist()
        falling = True
        for j, c in enumerate(line):
            if j and c != line[j - 1]:
                falling = c < line[j - 1]
            if falling and c <= how.k and (j + 1 == len(line) or line[j + 1] > c):
                a = int(starts[r, j])
                share = (isn[r, j] - isn[r, a]) / (j - a) if j > a else 0.0
                if share <= limit and not (how.inexact and c == 0):
                    out[r].append((a, j, c))
    return out


def fuzzy_any(seq: Column, pattern: str, how: Fuzzy) -> Column:
    """Whether a non-empty sequence has a match; null counts as none."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        own = texts.fillna("").tolist()
        return pd.Series([bool(x) and len(t) > 0 for x, t in zip(matches(own, pattern, how), own, strict=True)], dtype=bool)

    return found(seq)

"""The quality report: tables, a summary in Markdown, and one in JSON."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame

from strandframe.operators import qc
from strandframe.plans.parse import Span
from strandframe.schema import is_paired

_STATS = {"per_sequence_quality": "qual", "per_sequence_gc": "pct_gc", "sequence_length": "len"}


def _has_data(name: str, rows: list) -> bool:
    return any(r["count"] if "count" in r else r.get("total_count", 1) for r in rows) if rows else False


def report(df: DataFrame, folder: str, source: str = "reads", span: Span | None = None, skip: tuple[str, ...] = (), sample: int = qc.DUP_SAMPLE, percent: float = qc.OVER_PERCENT, as_json: bool = False) -> dict:
    """Writes the tables of all modules that aren't skipped; every table's size is bounded by positions and values.

    Overrepresented sequences are bounded by 100 / percent. Returns what the summary says.
    """
    modules = [m for m in qc.MODULES if m not in skip]
    if not modules:
        raise ValueError("all modules are skipped")
    own = qc.spanned(df, span).persist()
    os.makedirs(folder, exist_ok=True)
    start = (span.start or 0) if span else 0
    summary: dict = {"input": source, "reads": own.count(), "paired": is_paired(df), "modules": {}}
    lines = ["# Quality report", "", "| | |", "|-|-|", f"| input | {source} |", f"| reads | {summary['reads']} |", f"| paired | {summary['paired']} |"]
    try:
        for name in modules:
            sides = {}
            for mate, label in (("s", "R1"), ("x", "R2")) if summary["paired"] else (("s", "R1"),):
                if name == "per_base_quality" and f"{mate}_qual" not in df.columns or name == "per_sequence_quality" and f"{mate}_qual" not in df.columns:
                    continue
                side = {}
                for stem, table in qc.module(own, name, mate, sample, percent, start).items():
                    rows = [r.asDict() for r in table.collect()]
                    if not _has_data(stem, rows):
                        continue
                    side[stem] = rows
                    with open(os.path.join(folder, f"{stem}_{label}.tsv"), "w", encoding="utf-8") as f:
                        f.write("\t".join(rows[0]) + "\n")
                        f.writelines("\t".join(map(str, r.values())) + "\n" for r in rows)
                    if stem in _STATS:
                        side[f"{stem}_stats"] = qc.histogram_stats(df.sparkSession.createDataFrame(rows), _STATS[stem]).first().asDict()
                    if stem == "per_base_quality":
                        side["headline"] = qc.quality_headline(df.sparkSession.createDataFrame(rows)).first().asDict()
                if side:
                    sides[label] = side
            if sides:
                summary["modules"][name] = sides
                lines += ["", f"## {name}"]
                for label, side in sides.items():
                    lines += ["", f"### {label}"] if len(sides) > 1 else []
                    for key, value in side.items():
                        if isinstance(value, dict):
                            lines += ["", ", ".join(f"{k}: {v}" for k, v in value.items())]
                        elif key == "overrepresented":
                            lines += ["", *[f"- {r['sequence'][:40]}{'...' * (len(r['sequence']) > 40)}: {r['count']} ({r['pct']:.2f} %)" for r in value[: qc.TOP]]]
    finally:
        own.unpersist()
    with open(os.path.join(folder, "summary.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    if as_json:
        with open(os.path.join(folder, "summary.json"), "w", encoding="utf-8") as f:
            json.dump(summary, f, indent=1, default=str)
    return summary

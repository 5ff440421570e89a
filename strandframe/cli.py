"""The command line: one subcommand for each operator family, with sets of reads as folders."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from strandframe.functions.fuzzy import Fuzzy
from strandframe.operators import combine, encode, grep, pipe, report, transform, verify
from strandframe.plans import parse
from strandframe.plans.matching import Search, checked_span, in_span, search
from strandframe.schema import Meta, is_paired
from strandframe.sources import files, patterns, sinks, variants


def session(threads: int = 0) -> SparkSession:
    return SparkSession.builder.master(f"local[{threads or '*'}]").appName("strandframe").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _fuzzy_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("-z", "--fuzzy", action="store_true")
    p.add_argument("-k", "--distance", type=int, default=1)
    p.add_argument("-i", "--inexact", action="store_true")
    p.add_argument("--max-n-frac", type=parse.n_fraction)
    p.add_argument("-x", "--fixed", action="store_true")
    p.add_argument("--rc", action="store_true")
    p.add_argument("--no-dfa", action="store_true", help="accepted; results don't depend on it")
    p.add_argument("--file", action="append", default=[])
    p.add_argument("--sfile", action="append", default=[])
    p.add_argument("--xfile", action="append", default=[])


def _text_flags(p: argparse.ArgumentParser) -> None:
    p.add_argument("-o", "--output")
    p.add_argument("-p", "--prefix")
    p.add_argument("-f", "--format")
    p.add_argument("-c", "--compress")
    p.add_argument("-m", "--mate", choices=("1", "2", "both"), default="both")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandframe")
    top.add_argument("-T", "--threads", type=int, default=0)
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("encode")
    p.add_argument("inputs", nargs="*")
    p.add_argument("-o", "--output")
    p.add_argument("--mode", choices=("bq", "vbq", "cbq"))
    p.add_argument("-f", "--format")
    p.add_argument("-r", "--recursive")
    p.add_argument("--depth", type=int)
    p.add_argument("-M", "--manifest")
    p.add_argument("-P", "--paired", action="store_true")
    p.add_argument("-I", "--interleaved", action="store_true")
    p.add_argument("--collate", action="store_true")
    p.add_argument("--policy", default="r", choices=tuple("ipracgt"))
    p.add_argument("-H", "--skip-headers", action="store_true")
    p.add_argument("-Q", "--skip-quality", action="store_true")
    p.add_argument("-S", "--bits", type=int, choices=(2, 4), default=2)
    p.add_argument("-B", "--block-size", type=parse.memory_size, default=128 << 10)
    p.add_argument("-l", "--level", type=int, default=3)
    p.add_argument("-u", "--uncompressed", action="store_true")
    p.add_argument("-A", "--archive", action="store_true")

    p = sub.add_parser("decode")
    p.add_argument("input")
    p.add_argument("--span")
    _text_flags(p)

    p = sub.add_parser("cat")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)

    p = sub.add_parser("info")
    p.add_argument("inputs", nargs="+")
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("-n", "--num", action="store_true")
    kind.add_argument("--json", action="store_true")
    kind.add_argument("--show-index", action="store_true")
    kind.add_argument("--show-headers", action="store_true")

    p = sub.add_parser("grep")
    p.add_argument("input")
    p.add_argument("patterns", nargs="*")
    p.add_argument("-r", "--primary", action="append", default=[])
    p.add_argument("-R", "--extended", action="append", default=[])
    p.add_argument("-v", "--invert", action="store_true")
    p.add_argument("-H", "--header", action="store_true")
    p.add_argument("--or-logic", action="store_true")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    p.add_argument("--range")
    p.add_argument("--span")
    counted = p.add_mutually_exclusive_group()
    counted.add_argument("-C", "--count", action="store_true")
    counted.add_argument("-F", "--frac", action="store_true")
    counted.add_argument("-P", "--pattern-count", action="store_true")
    _fuzzy_flags(p)
    _text_flags(p)

    p = sub.add_parser("sample")
    p.add_argument("input")
    amount = p.add_mutually_exclusive_group(required=True)
    amount.add_argument("-F", "--fraction", type=parse.sample_fraction)
    amount.add_argument("-n", "--number", type=int)
    p.add_argument("-s", "--seed", type=int, default=42)
    p.add_argument("--span")
    _text_flags(p)

    p = sub.add_parser("split")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--skip-unmatched", action="store_true")
    p.add_argument("--unmatched-basename", default=combine.UNMATCHED)
    p.add_argument("--min-records", type=int, default=1)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--span")
    _fuzzy_flags(p)

    p = sub.add_parser("pipe")
    p.add_argument("input")
    p.add_argument("-p", "--pipes", type=int, default=0, help="0: as many as there are processors")
    p.add_argument("-b", "--basename", default="reads")
    p.add_argument("-f", "--format", default="fastq")
    p.add_argument("--span")
    how = p.add_mutually_exclusive_group()
    how.add_argument("-x", "--exec")
    how.add_argument("-X", "--exec-once")
    p.add_argument("--folder", default=".")

    p = sub.add_parser("qc")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--json", action="store_true")
    p.add_argument("--span")
    p.add_argument("--skip", action="append", default=[])
    p.add_argument("--dup-sample-size", type=int, default=100_000)
    p.add_argument("--overrep-threshold", type=parse.percentage, default=0.1)

    p = sub.add_parser("revcomp")
    p.add_argument("input")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-M", "--mate", choices=("1", "2", "both"), default="both")
    p.add_argument("--span")

    p = sub.add_parser("verify")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-M", "--mate", choices=("1", "2", "both"), default="both")
    p.add_argument("--json", action="store_true")
    p.add_argument("--span")
    for name in ("seq", "qual", "headers", "flags"):
        p.add_argument(f"--skip-{name}", action="store_true")
    return top


def _span(df: DataFrame, a: argparse.Namespace) -> parse.Span:
    """The span; one that starts behind the last read is an error, before anything is written."""
    span = parse.span(a.span)
    checked_span(df, span)
    return span


def _search(a: argparse.Namespace, **flags) -> Search:
    given = [x for scope, paths in (("either", a.file), ("primary", a.sfile), ("extended", a.xfile)) for path in paths for x in patterns.load(path, scope)]
    fuzzy = Fuzzy(a.distance, a.inexact, a.max_n_frac) if a.fuzzy else None
    return search(getattr(a, "patterns", ()), getattr(a, "primary", ()), getattr(a, "extended", ()), given, fuzzy=fuzzy, fixed=a.fixed, rc=a.rc, **flags)


def _write_text(df: DataFrame, a: argparse.Namespace) -> None:
    if a.prefix:
        sinks.write_mates(df, a.prefix, parse.output_format(None, a.format), a.mate, parse.compression(None, a.compress))
    else:
        sinks.write_file(df, a.output, parse.output_format(a.output, a.format), a.mate, parse.compression(a.output, a.compress))


def _encode(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.archive and (a.skip_headers or a.skip_quality):
        raise ValueError("an archive keeps headers and qualities")
    if a.recursive:
        inputs = files.in_directory(a.recursive, a.depth, a.paired)
    elif a.manifest:
        inputs, skipped = files.in_manifest(a.manifest, a.paired)
        if skipped:
            print(f"{skipped} lines of the manifest aren't read files", file=sys.stderr)
    else:
        inputs = a.inputs
    bits, block = (4, 200 << 20) if a.archive else (a.bits, a.block_size)
    variant = parse.output_variant(a.output, a.mode)
    meta = Meta(variant, False, not a.skip_quality, not a.skip_headers, a.format == "b", bits, block, a.level, not a.uncompressed)
    if not inputs:
        df = encode.load_stream(spark, sys.stdin.buffer, a.output, a.format, variant)
        variants.write_set(df, a.output, meta, a.policy)
        return
    jobs = encode.plan_jobs(inputs, a.output, a.mode, a.paired, a.interleaved, a.collate)
    for path, counts in encode.run(spark, jobs, meta, a.policy, a.format).items():
        print(f"{path}: {counts['written']} written, {counts['skipped']} skipped", file=sys.stderr)


def _grep(spark: SparkSession, a: argparse.Namespace) -> None:
    df = variants.read_set(spark, a.input).df
    s = _search(a, logic="or" if a.or_logic else "and", invert=a.invert, header=a.header, mate=a.mate, within=parse.base_range(a.range), span=_span(df, a))
    if a.pattern_count:
        print("name\tcount\tfrac_total")
        for r in grep.pattern_counts(df, s).collect():
            print(f"{r['name']}\t{r['count']}\t{r['frac_total']}")
    elif a.count or a.frac:
        r = grep.count(df, s).first()
        print(f"{r['count']},{r['total']},{r['frac']}" if a.frac else r["count"])
    else:
        colour = a.color == "always" or a.color == "auto" and sys.stdout.isatty()
        plain = not colour or a.output or a.prefix
        _write_text(grep.matching(df, s) if plain else grep.highlighted(df, s), a)


def _split(spark: SparkSession, a: argparse.Namespace) -> None:
    if not (a.file or a.sfile or a.xfile):
        raise ValueError("patterns come from a file")
    found = variants.read_set(spark, a.input)
    s = _search(a, span=_span(found.df, a))
    names = {"unmatched": a.unmatched_basename, "skip_unmatched": a.skip_unmatched}
    out = combine.split(found.df, s, a.min_records, **names)
    for r in combine.tallies(found.df, s, **names).collect():
        if not a.quiet:
            print(f"{r['alias']}\t{r['count']}", file=sys.stderr)
    combine.written_split(out, a.output)


def _sample(spark: SparkSession, a: argparse.Namespace) -> None:
    found = variants.read_set(spark, a.input)
    span = _span(found.df, a)
    df = transform.sample_fraction(found.df, a.fraction, a.seed, span) if a.fraction else transform.sample_number(found.df, a.number, a.seed, span)
    if a.output and parse.variant_of(a.output):
        parse.output_variant(a.output, None, found.meta.variant)
        variants.write_set(df, a.output, found.meta)
    else:
        _write_text(df, a)


def _pipe(spark: SparkSession, a: argparse.Namespace) -> None:
    df = variants.read_set(spark, a.input).df
    n, span = a.pipes or os.cpu_count() or 1, _span(df, a)
    if not (a.exec or a.exec_once):
        pipe.serve(df, n, os.path.join(a.folder, a.basename), a.format, span)
        return
    pipe.channels(a.exec or a.exec_once, is_paired(df))
    if a.exec:
        for r in pipe.per_shard(df, a.exec, n, a.format, a.basename, span).orderBy("shard").collect():
            sys.stdout.write(r["output"])
    else:
        sys.stdout.write(pipe.once(df, a.exec_once, n, a.folder, a.format, a.basename, span).stdout)


def _verify(spark: SparkSession, a: argparse.Namespace) -> None:
    out = []
    for path in a.inputs:
        df = variants.read_set(spark, path).df
        r = verify.checksum(df, _span(df, a), mate=a.mate, skip_seq=a.skip_seq, skip_qual=a.skip_qual, skip_headers=a.skip_headers, skip_flags=a.skip_flags).first()
        out.append({"checksum": r["checksum"], "records": r["n"], "path": path})
    if a.json:
        print(json.dumps(out[0] if len(out) == 1 else out))
    else:
        for o in out:
            print(f"{o['checksum']}\t{o['records']}\t{o['path']}")


def _info(a: argparse.Namespace) -> None:
    if a.show_headers:
        shown = 0
        for path in a.inputs:
            try:
                blocks = variants.block_headers(path)
            except (OSError, ValueError, KeyError) as e:
                print(f"{path} is left out: {e}", file=sys.stderr)
                continue
            shown += 1
            for b in blocks:
                print(json.dumps(b))
        if not shown:
            raise ValueError("none of the inputs is a readable cbq set")
        return
    found, bad = variants.infos(a.inputs, a.show_index)
    for p in bad:
        print(f"{p} can't be read", file=sys.stderr)
    if a.json:
        print(json.dumps(found))
    for x in [] if a.json else found:
        if a.num:
            print(f"{x['records']}\t{x['path']}")
        else:
            print("\n".join(f"{k}: {v:_}" if isinstance(v, int) and not isinstance(v, bool) else f"{k}: {v}" for k, v in x.items()))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "info":
            _info(a)
            return 0
        spark = session(a.threads)
        if a.command == "encode":
            _encode(spark, a)
        elif a.command == "decode":
            df = variants.read_set(spark, a.input).df
            _write_text(in_span(df, _span(df, a)), a)
        elif a.command == "cat":
            out = combine.cat([variants.read_set(spark, p) for p in a.inputs])
            parse.output_variant(a.output, None, out.meta.variant)
            variants.write_set(out.df, a.output, out.meta)
        elif a.command == "qc":
            df = variants.read_set(spark, a.input).df
            report.report(df, a.output, a.input, _span(df, a), tuple(a.skip), a.dup_sample_size, a.overrep_threshold, a.json)
        elif a.command == "revcomp":
            found = variants.read_set(spark, a.input)
            parse.output_variant(a.output, None, found.meta.variant)
            variants.write_set(transform.revcomp(in_span(found.df, _span(found.df, a)), a.mate), a.output, found.meta)
        else:
            {"grep": _grep, "split": _split, "sample": _sample, "pipe": _pipe, "verify": _verify}[a.command](spark, a)
        return 0
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.operators import combine, pipe, qc, report, transform, verify
from strandframe.plans import numbering, parse
from strandframe.plans.matching import search
from strandframe.plans.parse import Span
from strandframe.schema import Meta, ReadSet
from strandframe.sources.patterns import Pattern


@pytest.fixture(scope="module")
def reads(spark):
    rng = random.Random(11)
    rows = []
    for i in range(100):
        s, x = ("".join(rng.choice("ACGTN") for _ in range(rng.randint(20, 60))) for _ in "sx")
        q = "".join(chr(rng.randint(33, 80)) for _ in range(60))
        rows.append((i, f"seq.{i}", s, q[: len(s)], f"seq.{i}", x, q[: len(x)]))
    return spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string, x_header string, x_seq string, x_qual string").repartition(5)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_reverse_complement_twice(reads):
    assert rows(transform.revcomp(transform.revcomp(reads))) == rows(reads)
    once = transform.revcomp(reads, "2").select("idx", "s_seq")
    assert rows(once) == rows(reads.select("idx", "s_seq"))
    single = reads.select("idx", "s_seq", "s_qual")
    assert rows(transform.revcomp(single, "2")) == rows(transform.revcomp(single, "1"))


def test_samples_depend_on_seed_and_index_only(reads):
    a = rows(transform.sample_fraction(reads, 0.3))
    assert a == rows(transform.sample_fraction(reads.coalesce(1), 0.3)) and 10 < len(a) < 55
    assert a != rows(transform.sample_fraction(reads, 0.3, 7))
    assert transform.sample_fraction(reads, 1.0).count() == 100
    n = transform.sample_number(reads, 17)
    assert n.count() == 17 and rows(n) == rows(transform.sample_number(reads.repartition(2), 17))
    assert transform.sample_number(reads, 500, span=Span(10, 30)).count() == 20


def test_large_samples_equal_small_ones(reads, monkeypatch):
    want = rows(transform.sample_number(reads, 23))
    monkeypatch.setattr(transform, "TOP", 5)
    assert rows(transform.sample_number(reads, 23)) == want
    assert transform.sample_number(reads, 1000).count() == 100


@pytest.mark.parametrize("policy", list("iracgt"))
def test_n_policies(reads, policy):
    out = transform.n_policy(reads, policy)
    assert out.where("contains(s_seq, 'N') or contains(x_seq, 'N')").count() == 0
    assert policy == "i" or out.count() == 100
    assert rows(out) == rows(transform.n_policy(reads.coalesce(1), policy))


def test_n_policy_that_fails(reads):
    with pytest.raises(Exception, match="holds N"):
        transform.n_policy(reads, "p").collect()
    with pytest.raises(ValueError):
        transform.n_policy(reads, "z")


def test_records(spark):
    df = spark.createDataFrame([(0, "h", "ACGT", "IIIII", None, "", None), (1, None, "A", None, "m", "GG", "##")], "idx long, s_header string, s_seq string, s_qual string, x_header string, x_seq string, x_qual string")
    both = transform.decode(df, "fastq").orderBy("idx", "mate").collect()
    assert [(r.idx, r.mate, r.record) for r in both] == [(0, 1, "@h\nACGT\n+\nIIII"), (1, 1, "@1\nA\n+\n?"), (1, 2, "@m\nGG\n+\n##")]
    assert [r.record for r in transform.decode(df, "fasta", "2").orderBy("idx").collect()] == [">0\n", ">m\nGG"]
    assert [r.record for r in transform.decode(df.select("idx", "s_seq"), "tsv", "2").orderBy("idx").collect()] == ["0\tACGT", "1\tA"]


def test_checksums_ignore_order_and_see_changes(reads):
    for f in (verify.checksum, verify.md5_checksum):
        a = f(reads).first()
        assert a == f(reads.orderBy(F.rand())).first() and a.n == 100
        assert a.checksum != f(reads.withColumn("s_seq", F.concat("s_seq", F.lit("A")))).first().checksum
        assert f(reads, mate="1").first() == f(reads.select("idx", "s_header", "s_seq", "s_qual")).first()
    with pytest.raises(ValueError):
        verify.checksum(reads, skip_seq=True, skip_qual=True, skip_headers=True, skip_flags=True)
    with pytest.raises(ValueError):
        verify.checksum(reads.select("idx", "s_seq"), mate="2")
    with pytest.raises(ValueError):
        verify.checksum(reads.select("idx", "s_seq"), skip_seq=True)


def test_checksum_bytes(spark):
    import xxhash

    df = spark.createDataFrame([("AC", "II", "h")], "s_seq string, s_qual string, s_header string")
    want = xxhash.xxh3_64_hexdigest(b"".join(len(x).to_bytes(8, "little") + x for x in (b"AC", b"II", b"h")))
    assert verify.checksum(df).first().checksum == want


def test_checksum_wraps(spark):
    df = spark.createDataFrame([(f"A{i}",) for i in range(50)], "s_seq string")
    import xxhash

    total = sum(xxhash.xxh3_64_intdigest(len(x).to_bytes(8, "little") + x) for x in (f"A{i}".encode() for i in range(50)))
    assert verify.checksum(df).first().checksum == f"{total % 2**64:016x}"


PATTERNS = [Pattern("ACG", name="a"), Pattern("TTT", name="b"), Pattern("CGT", name="a"), Pattern("GGGGGGGG", name="none")]


def test_split_keeps_every_read(reads):
    s = search(files=PATTERNS)
    out = combine.routed(reads, s)
    assert rows(out.drop("alias")) == rows(reads)
    counts = {r.alias: r["count"] for r in combine.tallies(reads, s).collect()}
    assert sum(counts.values()) == 100 and counts["none"] == 0 and set(counts) == {"a", "b", "none", "unmatched"}
    for r in out.collect():
        hits = {p.name for p in PATTERNS if p.text in r.s_seq or p.text in r.x_seq}
        assert r.alias == (next(iter(hits)) if len(hits) == 1 else "unmatched")
    most = max(counts.values())
    assert {r.alias for r in combine.split(reads, s, most).collect()} == {a for a, n in counts.items() if n == most}
    assert combine.routed(reads, s, skip_unmatched=True).where("alias = 'unmatched'").count() == 0
    with pytest.raises(ValueError):
        combine.routed(reads, search(files=PATTERNS), unmatched="a")


def test_cat(reads):
    out = combine.cat([ReadSet(reads, Meta(paired=True)), ReadSet(reads, Meta(paired=True))])
    assert sorted(r.idx for r in out.df.select("idx").collect()) == list(range(200))
    with pytest.raises(ValueError):
        combine.cat([ReadSet(reads, Meta(paired=True)), ReadSet(reads, Meta(paired=True, bits=2))])


def test_shards(reads):
    got = {}
    for r in transform.shards(reads, 7, 3, 95).collect():
        got.setdefault(r.shard, []).append(r.idx)
    assert [len(got[k]) for k in range(7)] == [13] * 6 + [14]
    assert sorted(i for x in got.values() for i in x) == list(range(3, 95))
    assert {r.shard for r in transform.shards(reads, 9, 0, 4).collect()} == {8}


def test_numbers_are_contiguous(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = numbering.numbered(df, ["k"]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert numbering.numbered(df.where("false"), ["k"]).count() == 0


def test_quality_control_units(spark):
    df = spark.createDataFrame([(0, "GCAT", "!!~~"), (1, "", ""), (2, "gcn", "III")], "idx long, s_seq string, s_qual string")
    assert {r.pct_gc: r["count"] for r in qc.gc_content(df).where("count > 0").collect()} == {50: 1, 67: 1}
    assert [(r.len, r["count"]) for r in qc.seq_length(df).orderBy("len").collect()] == [(3, 1), (4, 1)]
    first = qc.base_content(df).where("pos = 0").first()
    assert (first.g, first.n, first.pct_g) == (2, 0, 100.0) and qc.base_content(df).where("pos = 2").first().n == 1
    assert {(r.pos, r.qual): r["count"] for r in qc.base_quality(df).collect()}[3, 93] == 1
    assert {r.qual: r["count"] for r in qc.seq_quality(df).where("count > 0").collect()} == {47: 1, 40: 1}


def test_duplication(spark):
    names = ["COMMON"] * 8 + ["RARE"] * 2 + ["SINGLETON"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "idx long, s_seq string")
    counts = qc.sequence_counts(df)
    assert [(r.sequence, r["count"]) for r in qc.overrepresented(counts, 50.0).collect()] == [("COMMON", 8)]
    assert [r.sequence for r in qc.overrepresented(counts, 10.0).collect()] == ["COMMON", "RARE"]
    levels = qc.duplication_levels(counts).collect()
    assert len(levels) == 16 and {r.level: (r.distinct_count, r.total_count) for r in levels if r.distinct_count} == {"1": (1, 1), "2": (1, 2), "8": (1, 8)}
    ten = spark.createDataFrame([("x", 10), ("y", 9)], "sequence string, count long")
    assert {r.level for r in qc.duplication_levels(ten).where("distinct_count > 0").collect()} == {"9", ">10"}
    assert qc.sequence_counts(df, sample=8).count() == 1


def test_histogram_stats(spark):
    h = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "v int, count long")
    assert tuple(qc.histogram_stats(h, "v").first()) == (4, 2.5, 3, 4)
    h = spark.createDataFrame([(100, 2), (150, 1)], "v int, count long")
    assert tuple(qc.histogram_stats(h, "v").first())[2:] == (100, 100)


def test_headline_ties(spark):
    h = spark.createDataFrame([(0, 10, 1), (1, 20, 1), (2, 10, 1), (3, 20, 1)], "pos int, qual int, count long")
    r = qc.quality_headline(h).first()
    assert (r.positions, r.mean, r.lowest_pos, r.highest_pos) == (4, 15.0, 0, 3)


def test_report(reads, tmp_path):
    out = report.report(reads, str(tmp_path / "qc"), as_json=True)
    assert set(out["modules"]) == set(qc.MODULES) and out["reads"] == 100
    assert (tmp_path / "qc" / "summary.md").read_text().startswith("# Quality report")
    assert (tmp_path / "qc" / "per_base_content_R2.tsv").exists() and (tmp_path / "qc" / "summary.json").exists()
    with pytest.raises(ValueError):
        report.report(reads, str(tmp_path / "none"), skip=qc.MODULES)
    late = report.report(reads, str(tmp_path / "late"), span=Span(50), sample=10, skip=tuple(m for m in qc.MODULES if m != "duplication"))
    assert sum(r["total_count"] for r in late["modules"]["duplication"]["R1"]["duplication_levels"]) == 10


def test_pipe(reads, tmp_path):
    out = pipe.per_shard(reads.select("idx", "s_header", "s_seq", "s_qual"), "echo {n} $(cat {} | wc -l)", 3).orderBy("shard").collect()
    assert [r.output.split() for r in out] == [["0", "132"], ["1", "132"], ["2", "136"]]
    pairs = pipe.per_shard(reads, "paste {R1} {R2} | wc -l", 4, "tsv").orderBy("shard").collect()
    assert [r.output.strip() for r in pairs] == ["50", "50"]
    with pytest.raises(Exception, match="ended with 3"):
        pipe.per_shard(reads, "cat {R1} > /dev/null; exit 3", 2).collect()
    with pytest.raises(ValueError):
        pipe.channels("cat", True)
    done = pipe.once(reads, "cat {R1} {R2} | wc -l", 4, str(tmp_path), "tsv")
    assert done.stdout.strip() == "200"


@given(st.integers(0, 50), st.integers(0, 50), st.integers(0, 40))
def test_span_bounds(a, b, n):
    if a > n:
        with pytest.raises(ValueError):
            Span(a, b).resolve(n)
    else:
        lo, hi = Span(a, b).resolve(n)
        assert list(range(n))[a:b] == list(range(lo, hi))


def test_parsing():
    assert parse.span("2..") == Span(2, None) and parse.span("..4") == Span(None, 4) and parse.span(None) == Span()
    assert parse.memory_size("64") == 64 and parse.memory_size("2K") == 2048 and parse.memory_size("1g") == 1 << 30
    for bad in ("x", "1-2"):
        with pytest.raises(ValueError):
            parse.span(bad)
    with pytest.raises(ValueError):
        parse.base_range("5..2")
    with pytest.raises(ValueError):
        parse.memory_size("1T")
    for bad in ("0", "1.5"):
        with pytest.raises(ValueError):
            parse.sample_fraction(bad)


def test_formats():
    assert parse.output_format("a/b.FQ.gz") == "fastq" and parse.output_format(None) == "tsv" and parse.output_format("x.txt") == "tsv" and parse.output_format("x.bin", "a") == "fasta"
    for bad in ("x.bam", "x.zzz", "fasta"):
        with pytest.raises(ValueError):
            parse.output_format(bad)
    assert parse.compression("x.gz") == "gzip" and parse.compression("x.gz", "u") is None and parse.compression("x.fa.zst") == "zstd"
    assert parse.input_format(["A.SAM"]) == "sam" and parse.input_format(["a.fq"]) == "fastx"
    assert parse.output_variant("x.vbq") == "vbq" and parse.output_variant("x", None) == "cbq" and parse.output_variant("x.vbq", "bq") == "bq"
    with pytest.raises(ValueError):
        parse.output_variant("x.vbq", None, "cbq")


def test_names():
    assert parse.encoded_name("a.fastq.gz", "cbq") == "a.cbq" and parse.encoded_name("d/a.fa", "bq") == "d/a.bq"
    assert parse.encoded_name("s_R1_001.fq.zst", "cbq", True) == "s_001.cbq" or parse.encoded_name("s_R1_001.fq.zst", "cbq", True) == "s.cbq"
    for bad in ("a.txt", "a.FQ", "a.fq.bz2"):
        with pytest.raises(ValueError):
            parse.encoded_name(bad, "cbq")
    pairs, alone = parse.pair_names(["b_R1.fq", "a_R2.fq", "a_R1.fq", "b_R2.fa", "c.fq"])
    assert pairs == [("a_R1.fq", "a_R2.fq")] and set(alone) == {"b_R1.fq", "b_R2.fa", "c.fq"}


def test_named_pipes_wait_for_their_readers(reads, tmp_path):
    import os
    import subprocess
    import threading
    import time

    base = str(tmp_path / "pipe")
    names = []
    server = threading.Thread(target=lambda: names.extend(pipe.serve(reads, 4, base, "tsv")))
    server.start()
    want = [f"{base}_{k}_R{m}.tsv" for k in range(2) for m in "12"]
    for _ in range(300):
        if all(map(os.path.exists, want)):
            break
        time.sleep(0.1)
    got = [subprocess.run(["cat", x], capture_output=True, text=True, timeout=120).stdout.splitlines() for x in reversed(want)]
    server.join(120)
    assert names == want and not any(map(os.path.exists, want))
    assert sum(map(len, got)) == 2 * reads.count() and got[-1][0].split("\t")[0] == reads.orderBy("idx").first().s_header

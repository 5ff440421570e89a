import gzip
import io
import os
import random

import pytest
import zstandard

from strandframe import cli
from strandframe.operators import encode, grep, transform, verify
from strandframe.plans.matching import search
from strandframe.schema import Meta, conform
from strandframe.sources import fastx, files, sam, sinks, variants
from strandframe.streaming import reads as streaming


def fastq(n, seed=1, letters="ACGT", mate=""):
    rng = random.Random(seed)
    rows = [(f"seq.{i}{mate}", "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))) for i in range(n)]
    # qualities that start with the letters of headers and separators
    return "".join(f"@{h}\n{s}\n+\n{(rng.choice('@+>I') + '?' * 99)[: len(s)]}\n" for h, s in rows), rows


def packed(text, kind):
    raw = text.encode()
    return {"": raw, ".gz": gzip.compress(raw[: len(raw) // 2]) + gzip.compress(raw[len(raw) // 2 :]), ".zst": zstandard.compress(raw)}[kind]


@pytest.mark.parametrize("kind", ["", ".gz", ".zst"])
def test_fastq_files(spark, tmp_path, kind):
    text, want = fastq(300)
    path = tmp_path / f"a.fq{kind}"
    path.write_bytes(packed(text, kind))
    for size in (500, 1 << 20):
        df = encode.load(spark, [str(path)], range_bytes=size)
        got = df.orderBy("idx").collect()
        assert [(r.s_header, r.s_seq) for r in got] == want and [r.idx for r in got] == list(range(300))
        assert all(len(r.s_qual) == len(r.s_seq) for r in got)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_fasta_ranges(spark, tmp_path, size):
    path = tmp_path / "a.fa"
    path.write_text("\n>one x\nACG\nTTT\n>two\n\n>three\nA\nC\nG\n>four\nGGGG")
    got = encode.load(spark, [str(path)], range_bytes=size).orderBy("idx").collect()
    assert [(r.s_header, r.s_seq, r.s_qual) for r in got] == [("one x", "ACGTTT", None), ("two", "", None), ("three", "ACG", None), ("four", "GGGG", None)]


def test_broken_files(spark, tmp_path):
    for k, text in enumerate(["@a\nACG\n+\nII\n", "hello\n", "@a\nACG\nIII\n+\n"]):
        path = tmp_path / f"{k}.fq"
        path.write_text(text)
        with pytest.raises(Exception, match="broken record|neither"):
            encode.load(spark, [str(path)]).collect()
    (tmp_path / "empty.fq").write_text("")
    assert encode.load(spark, [str(tmp_path / "empty.fq")]).count() == 0


def test_pairs_and_interleaved(spark, tmp_path):
    a, rows_a = fastq(40, 1)
    b, rows_b = fastq(40, 2)
    for name, text in (("s_R1.fq", a), ("s_R2.fq", b)):
        (tmp_path / name).write_text(text)
    got = encode.load(spark, [str(tmp_path / f"s_R{m}.fq") for m in "12"], "paired").orderBy("idx").collect()
    assert [(r.s_header, r.s_seq) for r in got] == rows_a and [(r.x_header, r.x_seq) for r in got] == rows_b
    mixed = "".join(f"@{h}\n{s}\n+\n{'I' * len(s)}\n" for pair in zip(rows_a, rows_b, strict=True) for h, s in pair)
    (tmp_path / "i.fq").write_text(mixed)
    got = encode.load(spark, [str(tmp_path / "i.fq")], "interleaved").orderBy("idx").collect()
    assert [(r.s_seq, r.x_seq) for r in got] == [(x[1], y[1]) for x, y in zip(rows_a, rows_b, strict=True)]
    (tmp_path / "odd.fq").write_text(mixed + "@z\nA\n+\nI\n")
    (tmp_path / "none.fq").write_text("")
    for name in ("odd.fq", "none.fq"):
        with pytest.raises(ValueError):
            encode.load(spark, [str(tmp_path / name)], "interleaved")
    (tmp_path / "short_R2.fq").write_text("@z\nA\n+\nI\n")
    with pytest.raises(ValueError):
        encode.load(spark, [str(tmp_path / "s_R1.fq"), str(tmp_path / "short_R2.fq")], "paired")


def test_sam(spark, tmp_path):
    lines = ["@HD\tVN:1.6"] + [f"r{i}\t4\t*\t0\t0\t*\t*\t0\t0\tACGTACGT\tIIIIIIII" for i in range(50)] + ["e\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    path = tmp_path / "a.sam"
    path.write_text("\n".join(lines) + "\n")
    df = encode.load(spark, [str(path)])
    rows = df.orderBy("idx").collect()
    assert len(rows) == 51 and rows[3].s_header == "r3" and rows[3].flag == 4 and rows[50].s_seq == "" and rows[50].s_qual is None
    out = encode.load_stream(spark, io.BytesIO(path.read_bytes()), "x.cbq", "b")
    assert out.count() == 51
    with pytest.raises(ValueError):
        encode.load_stream(spark, io.BytesIO(b""), "x.bq", "b", "bq")
    with pytest.raises(ValueError):
        encode.load_stream(spark, io.BytesIO(b""), None)
    with pytest.raises(ValueError):
        sam.scan(spark, "a.bam")


def test_streams(spark):
    text, rows = fastq(20)
    for raw in (text.encode(), gzip.compress(text.encode())):
        assert fastx.read_stream(spark, io.BytesIO(raw)).count() == 20


def test_variants(spark, tmp_path):
    rows = [(i, f"h{i}", "ACGN", "IIII", f"h{i}", "GG", "##") for i in range(30)]
    df = conform(spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string, x_header string, x_seq string, x_qual string"))
    sums = set()
    for variant in ("cbq", "vbq", "bq"):
        path = str(tmp_path / f"a.{variant}")
        variants.write_set(df, path, Meta(variant, True, bits=4))
        back = variants.read_set(spark, path)
        assert back.df.count() == 30 and ("s_qual" in back.df.columns) == (variant != "bq")
        sums.add(verify.checksum(back.df, skip_qual=True, skip_headers=True).first().checksum)
        seen = variants.info(path, index=True)
        assert seen["records"] == 30 and seen["blocks"] == len(seen["index"]) >= 1 and seen["paired"]
    assert len(sums) == 1
    path = str(tmp_path / "two.vbq")
    variants.write_set(df, path, Meta("vbq", True, bits=2), "i")
    assert variants.read_set(spark, path).df.count() == 0
    odd = df.withColumn("s_seq", df.s_header)
    with pytest.raises(Exception, match="another length"):
        variants.write_set(odd.unionByName(df), str(tmp_path / "odd.bq"), Meta("bq", True, bits=4))
    good, bad = variants.infos([path, "/nowhere"])
    assert len(good) == 1 and bad == ["/nowhere"]
    with pytest.raises(ValueError):
        variants.infos(["/nowhere"])


def test_finding_files(tmp_path):
    for name in ("a_R1.fq", "a_R2.fq", "b.fasta.gz", "c.txt", "sub/d_R1_001.fq.zst", "sub/sub/e.fa", "F.FQ"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    base = lambda x: sorted(os.path.relpath(p, tmp_path) for p in x)
    assert base(files.in_directory(str(tmp_path))) == ["a_R1.fq", "a_R2.fq", "b.fasta.gz", "sub/d_R1_001.fq.zst", "sub/sub/e.fa"]
    assert base(files.in_directory(str(tmp_path), 1)) == ["a_R1.fq", "a_R2.fq", "b.fasta.gz"]
    assert base(files.in_directory(str(tmp_path), 2, True)) == ["a_R1.fq", "a_R2.fq", "sub/d_R1_001.fq.zst"]
    with pytest.raises(ValueError):
        files.in_directory(str(tmp_path / "c.txt"))
    (tmp_path / "list").write_text("x.fq\n\ny.txt\nz.fa.gz\n")
    assert files.in_manifest(str(tmp_path / "list")) == (["x.fq", "z.fa.gz"], 1)
    assert files.in_manifest(f"file://{tmp_path}/list") == (["x.fq", "z.fa.gz"], 1)
    for depth, paired in ((None, False), (1, False), (2, True)):
        assert files.in_directory(f"file://{tmp_path}", depth, paired) == [f"file://{x}" for x in files.in_directory(str(tmp_path), depth, paired)]


def test_batch_goes_on_after_a_failure(spark, tmp_path):
    (tmp_path / "good.fq").write_text("@a\nACG\n+\nIII\n")
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nI\n")
    (tmp_path / "also.fa").write_text(">a\nACG\n")
    jobs = encode.plan_jobs(sorted(str(tmp_path / n) for n in ("good.fq", "bad.fq", "also.fa")))
    done = encode.run(spark, jobs, Meta())
    assert {os.path.basename(p) for p in done} == {"good.cbq", "also.cbq"} and not (tmp_path / "bad.cbq").exists()
    assert not variants.read_meta(str(tmp_path / "also.cbq")).quality
    with pytest.raises(Exception, match="broken"):
        encode.run(spark, [j for j in jobs if "bad" in j.output], Meta())


@pytest.mark.parametrize("compression", [None, "gzip", "zstd"])
def test_sinks(spark, tmp_path, compression):
    rows = [(i, f"h{i}", "ACG", "III", f"h{i}", "GG" if i % 2 else "", "##" if i % 2 else "") for i in range(9)]
    df = spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string, x_header string, x_seq string, x_qual string").repartition(4)
    path = str(tmp_path / "out")
    assert sinks.write_file(df, path, "fastq", "both", compression) == 13
    raw = open(path, "rb").read()
    text = gzip.decompress(raw) if compression == "gzip" else zstandard.ZstdDecompressor().decompressobj().decompress(raw) if compression else raw
    assert text.decode().startswith("@h0\nACG\n+\nIII\n@h1\nACG\n+\nIII\n@h1\nGG\n+\n##\n")
    names = sinks.write_mates(df, str(tmp_path / "p"), "fasta", compression=compression)
    assert [os.path.basename(n)[:5] for n in names] == ["p_R1.", "p_R2."]
    with pytest.raises(ValueError):
        sinks.write_mates(df.select("idx", "s_seq"), "x", "fasta")
    if compression != "zstd":
        sinks.write_folder(df, str(tmp_path / "folder"), "tsv", compression=compression)
        assert spark.read.text(str(tmp_path / "folder")).count() == 13


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda threads=0: spark)
    for name, seed in (("s_R1.fq", 1), ("s_R2.fq", 2)):
        (tmp_path / name).write_text(fastq(60, seed)[0])
    p = lambda name: str(tmp_path / name)

    def run(*args, code=0):
        assert cli.main([str(a) for a in args]) == code
        return capsys.readouterr().out

    run("encode", p("s_R1.fq"), p("s_R2.fq"), "-o", p("s.cbq"))
    assert run("info", "-n", p("s.cbq")) == f"60\t{p('s.cbq')}\n"
    assert '"records": 60' in run("info", "--json", p("s.cbq"))
    n, rest = (int(run("grep", p("s.cbq"), "ACG", *v, "-C")) for v in ((), ("-v",)))
    assert n + rest == 60
    assert run("grep", p("s.cbq"), "ACG", "-F").startswith(f"{n},60,")
    assert run("grep", p("s.cbq"), "ACG", "TTT", "-P").splitlines()[0] == "name\tcount\tfrac_total"
    run("grep", p("s.cbq"), "ACG", "-o", p("hits.fq.gz"))
    run("decode", p("s.cbq"), "-o", p("all.fa"), "-m", "1")
    assert open(p("all.fa")).read().count(">") == 60
    run("sample", p("s.cbq"), "-n", "7", "-o", p("few.cbq"))
    run("revcomp", p("s.cbq"), "-o", p("rc.cbq"))
    run("revcomp", p("rc.cbq"), "-o", p("rcrc.cbq"))
    a, b = (run("verify", p(x)).split()[0] for x in ("s.cbq", "rcrc.cbq"))
    assert a == b and len(a) == 16
    run("cat", p("s.cbq"), p("few.cbq"), "-o", p("both.cbq"))
    assert run("info", "-n", p("both.cbq")).split()[0] == "67"
    (tmp_path / "pat.tsv").write_text("one\tACGA\ntwo\tTTTT\n")
    run("split", p("s.cbq"), "--file", p("pat.tsv"), "-o", p("split"))
    run("qc", p("s.cbq"), "-o", p("qc"), "--json")
    assert os.path.exists(p("qc/summary.json"))
    assert sum(int(x) for x in run("pipe", p("s.cbq"), "-p", "4", "-f", "tsv", "-x", "cat {R1} | wc -l").split()) == 60
    late = ("--span", "61..70")
    for args in (("decode", p("s.cbq"), "-o", p("z.fa")), ("revcomp", p("s.cbq"), "-o", p("z.cbq")), ("sample", p("s.cbq"), "-F", "0.5", "-o", p("z.cbq")), ("verify", p("s.cbq")), ("qc", p("s.cbq"), "-o", p("z")), ("split", p("s.cbq"), "--file", p("pat.tsv"), "-o", p("z")), ("pipe", p("s.cbq"))):
        run(*args, *late, code=1)
    assert not any(os.path.exists(p(z)) for z in ("z", "z.fa", "z.cbq"))
    assert '"records": 60' in run("info", "--show-headers", p("s.cbq")) and '"s_seq"' in run("info", "--show-headers", p("s.cbq"))
    run("info", "--show-headers", p("nothing"), code=1)
    run("grep", p("s.cbq"), code=1)
    run("split", p("s.cbq"), "-o", p("no"), code=1)
    run("cat", p("s.cbq"), p("few.cbq"), "-o", p("x.vbq"), code=1)
    run("encode", "-r", str(tmp_path), "--paired", "--depth", "1", code=1)
    assert run("info", "-n", p("s.cbq")).split()[0] == "60"
    os.rename(p("s.cbq"), p("kept.cbq"))
    run("encode", "-r", str(tmp_path), "--paired", "--depth", "1")
    assert run("verify", p("s.cbq")).split()[:2] == run("verify", p("kept.cbq")).split()[:2]


def test_streaming(spark, tmp_path):
    rows = [(i, "AC" * 5 if i % 3 else "GG", "TT") for i in range(30)]
    df = conform(spark.createDataFrame(rows, "idx long, s_seq string, x_seq string"))
    folder = str(tmp_path / "in")
    df.repartition(3).write.parquet(folder)
    stream = streaming.source(spark, folder, files_per_trigger=1)

    def result(out, mode, name):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    s = search(["CAC"])
    batch = spark.read.schema(df.schema).parquet(folder)
    assert result(streaming.matching(stream, s).select("idx"), "append", "m1") == sorted(map(tuple, grep.matching(batch, s).select("idx").collect()))
    assert result(streaming.match_count(stream, s), "complete", "m2") == [(20, 30, "0.6667")]
    assert result(streaming.sampled(stream, 0.5).select("idx"), "append", "m3") == sorted(map(tuple, transform.sample_fraction(batch, 0.5).select("idx").collect()))
    assert result(streaming.gc_histogram(stream), "complete", "m4") == [(50, 20), (100, 10)]
    assert result(streaming.length_histogram(stream), "complete", "m5") == [(2, 10), (10, 20)]
    assert result(streaming.checksum(stream), "complete", "m6") == [tuple(verify.md5_checksum(batch).first())]

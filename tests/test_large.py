"""What large inputs need: nothing wide is sorted, the driver gets no rows, and a task's memory doesn't grow."""

import gzip
import hashlib
import io
import random

import pytest
import zstandard

from strandframe import queries as core
from strandframe.operators import encode, pipe
from strandframe.sources import fastx, sinks

DATA = "/root/testdata/sf0.001"


def test_reads_are_sorted_before_they_are_wide(spark):
    lines = core.derived(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = lines[next(k for k, x in enumerate(lines) if "Sort [idx" in x) :]
    assert any("md5" in x for x in lines) and not any("md5" in x for x in below)
    assert [r.idx for r in core.derived(spark, DATA).select("idx").limit(5).collect()] == [0, 1, 2, 3, 4]


def _fastq(n):
    rng = random.Random(5)
    rows = [(f"seq.{i}", "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 90)))) for i in range(n)]
    return rows, [(i, h, s, (rng.choice("@+>I") + "?" * 99)[: len(s)]) for i, (h, s) in enumerate(rows)]


def _table(spark, rows, parts):
    return spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string").repartitionByRange(parts, "idx").sortWithinPartitions("idx")


@pytest.mark.parametrize("kind", ["fastq", "fasta"])
@pytest.mark.parametrize("compression", ["gzip", "zstd"])
def test_packed_files_are_cut(spark, tmp_path, monkeypatch, compression, kind):
    """Blocks and frames are ranges of their own, at whatever place of a record they begin; others read them as plain gzip and zstd."""
    monkeypatch.setattr(sinks, "BLOCK", 700)
    monkeypatch.setattr(sinks, "FRAME", 900)
    want, rows = _fastq(500)
    path = str(tmp_path / "a")
    with open(path, "wb") as f:
        packed = sinks.Packed(f, compression)
        for _, h, s, q in rows:
            packed.write((f"@{h}\n{s}\n+\n{q}\n" if kind == "fastq" else f">{h}\n{s}\n").encode())
        packed.flush()
        sinks._end(f, compression, packed.frames)
    for size in (1, 500, 3000):
        parts = fastx.FastxReader([path], size).partitions()
        assert len(parts) > 1 and [p.start for p in parts[1:]] == [p.end for p in parts[:-1]]
        got = [r for p in parts for b in fastx.FastxReader([path], size).read(p) for r in zip(b["header"].to_pylist(), b["seq"].to_pylist(), strict=True)]
        assert got == want
    with open(path, "rb") as f:
        raw = f.read()
    text = gzip.decompress(raw) if compression == "gzip" else zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert text.count(b"seq.") == 500


@pytest.mark.parametrize("sort", [True, False])
def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch, sort):
    """Rows that are sorted already aren't shuffled; none go through the driver."""
    monkeypatch.setattr(sinks.DataFrame, "toLocalIterator", None)
    want, rows = _fastq(300)
    df = _table(spark, rows, 3) if sort else spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string").repartition(3)
    with sinks.pieces(sinks.part_text(df, "fastq", "both")) as found:
        assert (len(found) > 1 or not sort) and sum(p.records for p in found) == 300
    assert sinks.write_file(df, str(tmp_path / "a.fq.gz"), "fastq", "both", "gzip") == 300
    got = encode.load(spark, [str(tmp_path / "a.fq.gz")], range_bytes=2000).orderBy("idx").collect()
    assert [(r.s_header, r.s_seq) for r in got] == want and [r.idx for r in got] == list(range(300))


def test_shards_are_written_by_all_tasks(spark, monkeypatch, tmp_path):
    """No task reads a whole shard's rows, and the driver none."""
    monkeypatch.setattr(sinks.DataFrame, "toLocalIterator", None)
    _, rows = _fastq(300)
    out = pipe.per_shard(_table(spark, rows, 3), "cat {} | md5sum", 2, "tsv")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = [hashlib.md5("".join(f"{h}\t{s}\n" for _, h, s, _ in rows[a : a + 150]).encode()).hexdigest() for a in (0, 150)]
    assert [r.output.split()[0] for r in out.orderBy("shard").collect()] == want
    done = pipe.once(spark.createDataFrame(rows, "idx long, s_header string, s_seq string, s_qual string").repartition(3), "cat {} | md5sum", 2, str(tmp_path), "tsv")
    assert done.stdout.split()[0] == hashlib.md5("".join(f"{h}\t{s}\n" for _, h, s, _ in rows).encode()).hexdigest()


def test_merged_places_are_runs_of_their_own(spark):
    """A task that holds two sorted places of the numbers has a piece for each, and nothing is sorted again."""
    rows = [(i, f"h{i}", "A", "I") for k in (0, 2, 1, 3) for i in range(k * 10_000, k * 10_000 + 10_000)]
    mixed = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "idx long, s_header string, s_seq string, s_qual string")
    with sinks.pieces(sinks.part_text(mixed, "tsv", "both")) as found:
        assert {0, 20_000, 40_000, 60_000} <= {p.first for p in found} and all(p.last - p.first < 20_000 for p in found)


@pytest.mark.parametrize("chunk", [1, 50, 4 << 20])
@pytest.mark.parametrize(
    "text",
    ["@a b\nAC\n+\nII\n@c\n\n+x\n\n@d\nA\n+\n@\n", "@a\nA\n+\nI\n\n@b\r\nAC\r\n+\r\nII\r\n", "@a\nA\n+\nI\n@b\nA\n+\nI", ">a\nAC\n>b\nA\nC\n>c\n>d\n\n>e\nG", ">a\nA\n>b\nC\n>c\nG\n", "\n\n> a \nA \n", "", "@ \nA\n+\nI\n@é\nA\n+\nI\n"],
)
def test_cut_records_equal_read_ones(monkeypatch, text, chunk):
    """By many at once, the same records as one by one, for every place at which a range may end."""
    monkeypatch.setattr(fastx, "CHUNK", chunk)
    raw = text.encode()
    for until in (*range(len(raw) + 1), float("inf")):
        got = [tuple(r.values())[1:] for b in fastx.record_batches(io.BytesIO(raw), 0, until) for r in b.to_pylist()]
        assert got == list(fastx.records(io.BytesIO(raw), until))


def test_ranges_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(fastx, "MOST_RANGES", 7)
    (tmp_path / "a.fq").write_text("@a\nACG\n+\nIII\n" * 100)
    assert len(fastx.FastxReader([str(tmp_path / "a.fq")], 1).partitions()) == 7

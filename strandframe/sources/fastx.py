"""FASTA and FASTQ files as a Spark data source.

Plain files are cut into byte ranges; a task starts at the first record that begins in
its range and ends with the last that does. Compressed files are cut between gzip blocks
whose header says their length, and between zstd frames that a seek table lists, as
``sinks`` and others write them; compressed files of another kind are one task each. Where
a FASTQ record begins is found by its shape, as a quality line may start with ``@``,
too: a line with ``@``, then a sequence, a line with ``+``, and a quality of the
sequence's length.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file int, header string, seq string, qual string"
_ARROW = pa.schema([("file", pa.int32()), ("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
RANGE_BYTES = 64 << 20
BATCH = 16_384
#: Bytes whose records are cut at once.
CHUNK = 4 << 20
#: Times that packed text takes less bytes, roughly.
PACKED = 4
#: Ranges of all files together; larger files get longer ranges.
MOST_RANGES = 4096
#: The header of a gzip block that says its length, and the longest block.
BLOCK_HEAD, BLOCK_BYTES = re.compile(rb"\x1f\x8b\x08\x04.{6}\x06\x00BC\x02\x00(..)", re.DOTALL), 1 << 16
#: Of zstd's seekable format: a skippable frame's mark, and that at a seek table's end.
SKIPPED, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def open_path(path: str):
    """A random-access file of a local path or a URI."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def compression_of(head: bytes) -> str | None:
    """gzip or zstd by the first bytes."""
    return "gzip" if head[:2] == b"\x1f\x8b" else "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


class _Gunzip(io.RawIOBase):
    """Reads all members of a gzip file from byte ``at`` on; trailing zeros don't matter.

    ``limit`` is the number of plain bytes before the first member that begins at ``end``
    or later, once that is reached.
    """

    def __init__(self, source, at: int = 0, end: float = float("inf")):
        self.source, self.engine, self.have = source, zlib.decompressobj(31), b""
        self.at, self.end, self.plain, self.limit = at, end, 0, float("inf")

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.engine.eof:
                self.have, self.engine = self.engine.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
                if self.at - len(self.have) >= self.end:
                    self.limit = min(self.limit, self.plain)
            data = self.have
            if not data:
                data = self.source.read(1 << 16)
                self.at += len(data)
            self.have = b""
            if not data:
                return 0
            out = self.engine.decompress(data, len(target))
            self.have = self.engine.unconsumed_tail
            if out:
                target[: len(out)] = out
                self.plain += len(out)
                return len(out)


def gzip_cuts(source, n: int, size: int) -> list[int]:
    """Bytes at which blocks begin, about ``size`` apart; none if the file isn't in blocks."""
    out: list[int] = []
    source.seek(0)
    if not BLOCK_HEAD.match(source.read(18)):
        return out
    for a in range(size, n, size):
        source.seek(a)
        data, found = source.read(2 * BLOCK_BYTES + 18), None
        while found := BLOCK_HEAD.search(data, found.start() + 1 if found else 0):
            after = found.start() + int.from_bytes(found[1], "little") + 1
            if BLOCK_HEAD.match(data, after) or a + after == n:  # what looks like a header within a block has no such neighbour
                if not out or a + found.start() > out[-1]:
                    out.append(a + found.start())
                break
    return out


def zstd_frames(source, n: int) -> list[tuple[int, int]]:
    """Packed and plain sizes of the frames that a seek table at the file's end lists; none without one."""
    if n < 17:
        return []
    source.seek(n - 9)
    count, kind, mark = struct.unpack("<IBI", source.read(9))
    each = 12 if kind & 0x80 else 8  # with or without checksums
    begin = n - 17 - count * each
    if mark != SEEKABLE or begin < 0:
        return []
    source.seek(begin)
    table = source.read(8 + count * each)
    frames = [struct.unpack_from("<II", table, 8 + k * each) for k in range(count)]
    fits = struct.unpack_from("<II", table) == (SKIPPED, len(table) + 1) and sum(x for x, _ in frames) == begin
    return frames if fits else []


def text_stream(source):
    """A buffered stream of the file's uncompressed bytes."""
    head = source.read(4)
    source.seek(0)
    kind = compression_of(head)
    if kind == "gzip":
        return io.BufferedReader(_Gunzip(source), 1 << 18)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True, closefd=False), 1 << 18)
    return io.BufferedReader(_Raw(source), 1 << 18)


class _Raw(io.RawIOBase):
    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self.source.read(len(target))
        target[: len(data)] = data
        return len(data)


def records(stream, until: float | Callable[[], float] = float("inf"), at: int = 0) -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, quality) of the records that begin before byte ``until`` of a stream that stands at ``at``, at the start of one."""
    end = until if callable(until) else lambda: until
    line = stream.readline()
    while line and not line.strip():
        at += len(line)
        line = stream.readline()
    if line[:1] == b">":
        header, parts, begin = line[1:], [], at
        while header is not None and begin < end():
            at += len(line)
            line = stream.readline()
            if not line or line[:1] == b">":
                yield header.strip().decode(), b"".join(parts).decode(), None
                header, parts, begin = (line[1:], [], at) if line else (None, [], at)
            else:
                parts.append(line.strip())
    elif line[:1] == b"@":
        while line and at < end():
            if not line.strip():
                at += len(line)
                line = stream.readline()
                continue
            seq, plus, qual = stream.readline(), stream.readline(), stream.readline()
            bases, marks = seq.strip(), qual.strip()
            if line[:1] != b"@" or plus[:1] != b"+" or len(bases) != len(marks):
                raise ValueError(f"a broken record begins at byte {at}")
            yield line[1:].strip().decode(), bases.decode(), marks.decode()
            at += len(line) + len(seq) + len(plus) + len(qual)
            line = stream.readline()
    elif line:
        raise ValueError("neither FASTA nor FASTQ")


def first_record(source, start: int, end: int) -> int | None:
    """The first byte from ``start``, before ``end``, at which a record begins."""
    if start == 0:
        return 0
    source.seek(0)
    fasta = source.read(1 << 16).lstrip()[:1] == b">"
    source.seek(start - 1)
    return _next_record(io.BufferedReader(_Raw(source), 1 << 18), start - 1, lambda: end, fasta)


def _next_record(stream, at: int, end: Callable[[], float], fasta: bool) -> int | None:
    """The byte, before ``end``, at which the first record after a line feed begins, of a stream that stands at ``at``."""
    at += len(stream.readline())  # the rest of a line, or only its line feed
    window: list[tuple[int, bytes]] = []
    while True:
        line = stream.readline()
        if not line:
            return None
        if fasta:
            if at >= end():
                return None
            if line[:1] == b">":
                return at
        window.append((at, line.strip()))
        at += len(line)
        if len(window) == 4:
            (place, a), (_, b), (_, c), (_, d) = window
            if not fasta and a[:1] == b"@" and c[:1] == b"+" and len(b) == len(d):
                return place if place < end() else None
            if place >= end() + (1 << 20):
                return None
            window.pop(0)


@dataclass
class Part(InputPartition):
    file: int
    path: str
    start: int
    end: int | None
    packed: str | None = None  # a range of blocks or frames: gzip or zstd
    plain: int = 0  # bytes that the frames hold

    def __post_init__(self):
        super().__init__(self.path)


def batches(rows: Iterator[tuple[str, str, str | None]], file: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, str | None]] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held, file)
            held = []
    if held:
        yield _batch(held, file)


def _batch(held: list, file: int) -> pa.RecordBatch:
    header, seq, qual = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.int32()), pa.array(header, pa.string()), pa.array(seq, pa.string()), pa.array(qual, pa.string())], schema=_ARROW)


class _Again(io.RawIOBase):
    """Bytes that were read already, then the rest of their stream."""

    def __init__(self, held: bytes, stream):
        self.held, self.stream = memoryview(held), stream

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        if not self.held:
            return self.stream.readinto(target)
        n = min(len(target), len(self.held))
        target[:n], self.held = self.held[:n], self.held[n:]
        return n


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _lines(buf: bytes) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Lines a record, and where the lines of whole records begin and end; None if they need a closer look.

    These have four lines, or two in FASTA, and no space at a line's ends.
    """
    raw = np.frombuffer(buf, np.uint8)
    each = {64: 4, 62: 2}.get(buf[0])
    if each is None or len(buf) >= 1 << 31:
        return None
    feeds = np.flatnonzero(raw == 10)
    n = len(feeds) // each * each
    if each == 2 and n and feeds[n - 1] + 1 == len(buf):  # its sequence may go on
        n -= 2
    ends = feeds[:n]
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].astype(np.int64)
    if not n:
        return each, starts, ends
    size, first = ends - starts, raw[starts]
    heads = starts[::each]
    odd = ((_SPACE[first] | _SPACE[raw[ends - 1]]) & (size > 0)).any() or (_SPACE[raw[heads + 1]] & (size[::each] > 1)).any() or (first[::each] != buf[0]).any()
    if each == 4:
        odd = odd or (first[2::4] != 43).any() or (size[1::4] != size[3::4]).any()
    else:
        odd = odd or (first[1::2] == 62).any() or raw[ends[-1] + 1] != 62
    return None if odd else (each, starts, ends)


def record_batches(stream, file: int, until: float | Callable[[], float] = float("inf"), at: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of ``records``: plain ones are cut by many at once, and from the first that isn't one by one."""
    end = until if callable(until) else lambda: until
    held = b""
    while data := stream.read(CHUNK):
        held += data
        found = _lines(held)
        if found is None:
            break
        each, starts, ends = found
        if not len(ends):
            continue
        own = int(np.count_nonzero(starts[::each] + at < end()))
        offsets = np.concatenate([starts, ends[-1:] + 1]).astype(np.int32)
        lines = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
        line = lambda k, skip: pc.binary_slice(lines.take(pa.array(np.arange(k, own * each, each))), skip, -1).cast(pa.string())  # noqa: B023, E731
        if own:
            qual = line(3, 0) if each == 4 else pa.nulls(own, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own, file, np.int32)), line(0, 1), line(1, 0), qual], schema=_ARROW)
        if own < len(starts) // each:
            return
        held, at = held[ends[-1] + 1 :], at + int(ends[-1]) + 1
    yield from batches(records(io.BufferedReader(_Again(held, stream), 1 << 18), end, at), file)


class FastxReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Part]:
        opened = []
        for path in self.paths:
            with open_path(path) as f:
                opened.append(f.size())
        least = -(-sum(opened) // MOST_RANGES)
        size, out = max(self.size, least), []
        for k, (path, n) in enumerate(zip(self.paths, opened, strict=True)):
            with open_path(path) as f:
                kind = compression_of(f.read(4))
                if not kind:
                    out += [Part(k, path, a, min(n, a + size)) for a in range(0, n, size)]
                else:
                    out += self._packed(k, path, f, n, max(1, self.size // PACKED, least), kind) or [Part(k, path, 0, None)]
        return out or [Part(0, "", 0, 0)]

    @staticmethod
    def _packed(file: int, path: str, f, n: int, size: int, kind: str) -> list[Part]:
        """Ranges of a file of blocks or frames."""
        if kind == "gzip":
            cuts = gzip_cuts(f, n, size)
            return [Part(file, path, a, b, kind) for a, b in zip([0, *cuts], [*cuts, n], strict=True)] if cuts else []
        at, held, frames = [0], [0], zstd_frames(f, n)
        for x, y in frames:
            at.append(at[-1] + x)
            held.append(held[-1] + y)
        ends = sorted({bisect_left(at, min(a, at[-1])) for a in range(size, n + size, size)}) if frames else []
        return [Part(file, path, at[a], at[b], kind, held[b] - held[a]) for a, b in zip([0, *ends], ends, strict=False)]

    def read(self, partition: Part):
        if not partition.path:
            return
        with open_path(partition.path) as f:
            if partition.packed:
                yield from _packed_batches(f, partition)
                return
            if partition.end is None:
                yield from record_batches(text_stream(f), partition.file)
                return
            begin = first_record(f, partition.start, partition.end)
            if begin is not None:
                f.seek(begin)
                yield from record_batches(io.BufferedReader(_Raw(f), 1 << 18), partition.file, partition.end, begin)


def _packed_batches(source, part: Part) -> Iterator[pa.RecordBatch]:
    """Records of a range of blocks or frames: those that begin after a line feed in it, and in the first range the file's first."""

    def stream():
        source.seek(part.start)
        if part.packed == "gzip":
            raw = _Gunzip(source, part.start, part.end)
            return io.BufferedReader(raw, 1 << 18), lambda: raw.limit + 1
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True, closefd=False)
        return io.BufferedReader(raw, 1 << 18), lambda: part.plain + 1

    begin = 0
    if part.start:
        source.seek(0)
        fasta = text_stream(source).read(1 << 16).lstrip()[:1] == b">"
        own, end = stream()
        begin = _next_record(own, 0, end, fasta)
    if begin is None:
        return
    own, end = stream()
    left = begin
    while left:
        left -= len(own.read(min(left, 1 << 20)))
    yield from record_batches(own, part.file, end, begin)


class FastxSource(DataSource):
    """format("fastx"): option ``paths`` holds the paths, one a line; ``range_bytes`` the size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        given = self.options.get("paths") or self.options.get("path") or ""
        return FastxReader([p for p in given.split("\n") if p], int(self.options.get("range_bytes", RANGE_BYTES)))


def scan(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, header, seq, qual of all records, in order."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("paths", "\n".join(paths)).option("range_bytes", str(range_bytes)).load()


def read_stream(spark: SparkSession, stream) -> DataFrame:
    """The records of an open binary stream, such as standard input, which the driver reads."""
    if not hasattr(stream, "peek"):
        stream = io.BufferedReader(stream)
    head = stream.peek(4)[:4]
    if compression_of(head):
        stream = text_stream(io.BytesIO(stream.read()))
    table = pa.Table.from_batches(list(batches(records(stream), 0)), schema=_ARROW)
    return spark.createDataFrame(table)

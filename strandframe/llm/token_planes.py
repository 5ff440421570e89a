"""Token ids in files of bit or byte planes.

A file holds blocks of ``BLOCK`` ids (the last may be shorter). A block is
transposed: plane k has bit k (or byte k) of every id. Each plane is compressed with
zstandard on its own. All numbers are little-endian.

    magic, the blocks' planes one after the other, footer, footer length (8 bytes), magic

The footer is zstandard-compressed: ids' width in planes, bits a plane (1 or 8),
block size, number of ids, of blocks and of documents as eight-byte integers; for
each plane of each block its place and length; the documents' token counts; their
keys as an Arrow stream of one column, so keys of any type come back as they were. A
reader needs the footer to find any block or document.

Writing sorts the documents by key into ranges, one file a task; a task writes to a
name of its own and renames the file when it is whole, so a task that runs again
replaces it with an equal one.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import tokens
from strandframe.llm.common import slices

MAGIC = b"IDPLANE2"
BLOCK = 1 << 16
LEVEL = 1


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first, without those above the highest that isn't zero."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    most = int(ids.max()) if len(ids) else 0
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range((most.bit_length() + 7) // 8)]
    flat = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(most.bit_length())]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        rows = np.zeros((n, 4), np.uint8)
        for k, x in enumerate(planes):
            rows[:, k] = np.frombuffer(x, np.uint8)
    else:
        flat = np.zeros((n, 32), np.uint8)
        for k, x in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little")
        rows = np.packbits(flat, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4").copy() if n else np.zeros(0, "<u4")


class PlaneWriter:
    """Writes one file; ``out`` needs only ``write``. key_type: the Arrow type of the keys; without it, Arrow tells it from them."""

    def __init__(self, out, bits: int = 8, block: int = BLOCK, key_type: pa.DataType | None = None):
        self.out, self.bits, self.block, self.key_type = out, bits, block, key_type
        self.at, self.rest, self.waiting, self.n = len(MAGIC), [], 0, 0
        self.index: list[tuple[int, list[tuple[int, int]]]] = []
        self.keys: list[object] = []
        self.counts: list[int] = []
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL)
        out.write(MAGIC)

    def add(self, key, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            whole = np.concatenate(self.rest)
            for a in range(0, len(whole) - self.block + 1, self.block):
                self._block(whole[a : a + self.block])
            kept = whole[len(whole) // self.block * self.block :]
            self.rest, self.waiting = [kept], len(kept)

    def _block(self, ids: np.ndarray) -> None:
        places = []
        for plane in to_planes(ids, self.bits):
            data = self.squeeze.compress(plane)
            self.out.write(data)
            places.append((self.at, len(data)))
            self.at += len(data)
        self.index.append((len(ids), places))
        self.n += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        planes = 32 // self.bits
        places = np.zeros((len(self.index), planes, 2), "<i8")
        for k, (_, own) in enumerate(self.index):
            if own:
                places[k, : len(own)] = own
        head = struct.pack("<6q", planes, self.bits, self.block, self.n, len(self.index), len(self.keys))
        keys = pa.record_batch([pa.array(self.keys, self.key_type)], ["key"])
        stream = io.BytesIO()
        with pa.ipc.new_stream(stream, keys.schema) as to:
            to.write_batch(keys)
        body = head + places.tobytes() + np.asarray(self.counts, "<i8").tobytes() + stream.getvalue()
        footer = self.squeeze.compress(body)
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)


class PlaneReader:
    """Reads a file by its footer; ``source`` needs ``seek``, ``read`` and ``size``."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < 2 * len(MAGIC) + 8:
            raise ValueError("not a plane file")
        tail = self._at(size - len(MAGIC) - 8, len(MAGIC) + 8)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file")
        (length,) = struct.unpack("<q", tail[:8])
        self.loose = zstandard.ZstdDecompressor()
        body = self.loose.decompress(self._at(size - len(MAGIC) - 8 - length, length))
        self.planes, self.bits, self.block, self.n, blocks, docs = struct.unpack("<6q", body[:48])
        a = 48 + blocks * self.planes * 16
        self.places = np.frombuffer(body[48:a], "<i8").reshape(blocks, self.planes, 2)
        self.counts = np.frombuffer(body[a : a + 8 * docs], "<i8")
        own = pa.ipc.open_stream(body[a + 8 * docs :]).read_all().column("key")
        self.key_type, self.keys = own.type, own.to_pylist()

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n - k * self.block)
        planes = [self.loose.decompress(self._at(int(p), int(length))) for p, length in self.places[k] if length]
        return from_planes(planes, n, self.bits)

    def __iter__(self):
        """(key, ids) of each document, with one block in memory beside the document."""
        have, k = np.zeros(0, "<u4"), 0
        for key, count in zip(self.keys, self.counts.tolist(), strict=True):
            parts, missing = [], count
            while missing > len(have):
                parts.append(have)
                missing -= len(have)
                have, k = self.read_block(k), k + 1
            parts.append(have[:missing])
            have = have[missing:]
            yield key, np.concatenate(parts) if len(parts) > 1 else parts[0]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2, bits: int = 8) -> DataFrame:
    """Encodes whole texts, appends ``end_id`` to each, and writes them in ascending key order below ``folder``.

    Returns one row per file: part, path, n_docs, n_ids. Null texts are empty. Null
    keys come first; rows with equal keys are ordered by their texts' hash.
    """

    def run(batches):
        coder, tail = tokens.encoder(path, "words"), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        system, base = _file_system(folder)
        writer = out = None
        mine = f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                if writer is None and len(piece):
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(mine)
                    writer = PlaneWriter(out, bits, key_type=piece.schema.field("doc_id").type)
                for key, blob in zip(piece.column("doc_id").to_pylist(), coder.encode(piece.column("text").fill_null("").to_pylist()), strict=True):
                    writer.add(key, np.frombuffer(blob + tail, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            system.move(mine, f"{base}/part-{part:06d}.planes")
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.planes"], "n_docs": pa.array([len(writer.keys)], pa.int64()), "n_ids": pa.array([writer.n], pa.int64())}
            )

    # rows that share a doc_id can still be dealt to several tasks, by their texts
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "part int, path string, n_docs long, n_ids long")


def read_digests(spark: SparkSession, files: list[tuple[str, int]], key_type: str) -> DataFrame:
    """Reads files back, given as (path, ids of all documents before): doc_id, start, n_tokens, ids_crc32 of each document."""
    schema = f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, place = _file_system(path)
                with system.open_input_file(place) as source:
                    keys, starts, counts, sums = [], [], [], []
                    reader = PlaneReader(source)
                    for key, ids in reader:
                        keys.append(key)
                        starts.append(start)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.tobytes()))
                        start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(keys, reader.key_type), *(pa.array(x, pa.int64()) for x in (starts, counts, sums))], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = spark.createDataFrame(files, "path string, start long")
    return rows.repartition(len(files), F.col("path")).mapInArrow(run, schema)


def write_and_read(docs: DataFrame, path: str, folder: str, end_id: int = 2, bits: int = 8) -> DataFrame:
    """Writes the files, then returns what is read back from them.

    The driver holds one row per file. An empty table writes no file.
    """
    made = sorted(write(docs, path, folder, end_id, bits).collect(), key=lambda r: r["part"])
    files, start = [], 0
    for r in made:
        files.append((r["path"], start))
        start += r["n_ids"]
    return read_digests(docs.sparkSession, files, docs.schema["doc_id"].dataType.simpleString())


def dumps(docs: list[tuple[object, np.ndarray]], bits: int = 8, block: int = BLOCK) -> bytes:
    """One file in memory."""
    out = io.BytesIO()
    writer = PlaneWriter(out, bits, block)
    for key, ids in docs:
        writer.add(key, ids)
    writer.close()
    return out.getvalue()

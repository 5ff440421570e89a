"""Media columns: texts as sound, read back, with spectral fingerprints.

A payload is stored as an 8-bit mono WAV file, made and read by the wave module.
Frames of ``FRAME`` samples go through a windowed Fourier transform; the strongest
bin of each of ``BANDS`` bands is a peak if it lies above the frame's mean. Each peak
is paired with the peaks of the next ``REACH`` frames in the same and the next band.
A pair is (time, code): the frame of its first peak, and both bins and the distance
in one integer. Pairs are arrays in time order.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from strandframe.llm.common import ids_type, slices

RATE = 8000
FRAME = 192
BANDS = (1, 6, 12, 24, 48, 97)
REACH = 2
#: Frames that are transformed at once.
CHUNK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and the text padded with spaces to a positive multiple of FRAME."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        if f.getnchannels() != 1 or f.getsampwidth() != 1:
            raise ValueError("8-bit mono only")
        return f.readframes(f.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The peak bin of each band in each frame (frames x bands); 0 where there is none."""
    frames = samples.reshape(-1, FRAME)
    out = np.zeros((len(frames), len(BANDS) - 1), np.int64)
    for a in range(0, len(frames), CHUNK):
        part = (frames[a : a + CHUNK].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        floor = power[:, BANDS[0] :].mean(axis=1)
        for k, (low, high) in enumerate(zip(BANDS[:-1], BANDS[1:], strict=True)):
            band = power[:, low:high]
            top = band.argmax(axis=1)
            strong = band[np.arange(len(band)), top] > floor
            out[a : a + CHUNK, k] = np.where(strong, top + low, 0)
    return out


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of all peak pairs, by time and then code."""
    times, codes = [], []
    for step in range(1, REACH + 1):
        for k in range(found.shape[1]):
            for to in (k, k + 1):
                if to < found.shape[1] and len(found) > step:
                    a, b = found[:-step, k], found[step:, to]
                    at = np.flatnonzero((a > 0) & (b > 0))
                    times.append(at)
                    codes.append((a[at] * 128 + b[at]) * 4 + step)
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order], c[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    return pairs(peaks(np.frombuffer(samples, np.uint8)))


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary, times array<int>, codes array<int>): the length and the WAV file of each text, and its fingerprint.

    Null texts are empty and become one frame of spaces; repeated rows stay.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                made = [payload_of(x) for x in part.column("text").to_pylist()]
                media = [to_wav(payload) for _, payload in made]
                prints = [fingerprint(from_wav(x)) for x in media]
                arrays = [pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary()), *(pa.array([p[k].astype(np.int32) for p in prints], pa.list_(pa.int32())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "n_bytes", "media", "times", "codes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids_type(docs)}, n_bytes long, media binary, times array<int>, codes array<int>")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of the rows of ``media_table``: its stored bytes are read back, and its arrays are taken as they are.

    feature: number of pairs, and the XXH64 of their times and codes.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                stored = batch.column("media")[k].as_py()
                back = from_wav(stored)
                t, c = (np.asarray(batch.column(x)[k].values) for x in ("times", "codes"))
                digest = xxhash.xxh64(t.astype("<i4").tobytes() + c.astype("<i4").tobytes()).hexdigest()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(t)}:{digest}"))
            if rows:
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", "n_bytes", *names])

    schema = f"doc_id {ids_type(media)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)

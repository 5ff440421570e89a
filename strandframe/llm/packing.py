"""Order-preserving packing of token streams into sequences of bounded length.

Every task packs the documents of its input split in their order; nothing is
shuffled and no document moves. The token stream of a segment may be cut at
document ends, at sentence ends, and, only where a sentence is longer than
``max_len``, every ``LONG_STEP`` tokens of it. A dynamic program picks the cuts: ``f(j) = min f(i) + padding(i, j) +
SEQUENCE_COST + penalty(j)`` over the starts ``i`` at most ``max_len`` tokens before
``j``. As the padding is ``max_len - (j - i)``, the best start is the minimum of
``f(i) + i`` in a sliding window, which a monotone queue gives in constant time a
cut. Lengths that are powers of two need no padding; those from ``max_len`` / ``POWERS`` on
are tried by lookup.

A segment is closed at a document end once it holds ``SEGMENT`` tokens. Its last
window isn't written but carried into the next segment, so that memory is bounded
and padding doesn't depend on where segments end.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandframe.llm import tokens
from strandframe.llm.common import ids_type, slices

SEGMENT = 1 << 20
LONG_STEP = 64
#: Shorter sequences than this part of a whole one aren't made on purpose, even where they need no padding.
POWERS = 16
#: In tokens of padding: what another sequence costs, a cut at a sentence end, and one within a sentence.
SEQUENCE_COST, SENTENCE_CUT, LONG_CUT = 4, 2, 16


def cut_points(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, the last one its end, and the penalty of each.

    ends: where documents end; closes: by id, whether it ends a sentence.
    """
    kind = closes[ids].astype(np.uint8)  # of the token before each cut: 1 ends a sentence, 2 a document, 3 stands in a long sentence
    kind[ends - 1] = 2
    at = np.flatnonzero(kind) + 1
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > max_len)
    if len(long):
        step = min(LONG_STEP, max_len)
        for k in long.tolist():
            kind[at[k] - gaps[k] + step - 1 : at[k] - 1 : step] = 3
        at = np.flatnonzero(kind) + 1
    return at, np.array([0, SENTENCE_CUT, 0, LONG_CUT])[kind[at - 1]]


def best_cuts(at: list[int], penalty: list[int], max_len: int) -> list[int]:
    """The cheapest sequence ends among the cut points; the last point is one."""
    pos = [0, *at]
    powers = [1 << k for k in range(max_len.bit_length()) if max_len <= POWERS << k < POWERS * max_len]
    index = {0: 0}
    cost, came = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, cut), ascending
    for j in range(1, len(pos)):
        here = pos[j]
        low = here - max_len
        while pos[queue[0][1]] < low:
            queue.popleft()
        key, i = queue[0]
        best = key + max_len - here
        for p in powers:
            k = index.get(here - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += SEQUENCE_COST + penalty[j - 1]
        cost[j], came[j] = best, i
        index[here] = j
        key = best + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j))
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = came[j]
    return out[::-1]


def sentence_ends(path: str) -> np.ndarray:
    """By id: whether the token ends in a full stop, question or exclamation mark or holds a line feed."""
    vocab = tokens.library(path).get_vocab(with_added_tokens=True)
    line = tokens.byte_letters()[10]
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token.endswith((".", "!", "?")) or line in token
    return out


class _Segment:
    """Documents whose tokens aren't all written yet: (key, tokens before, tokens of the document, ids)."""

    def __init__(self) -> None:
        self.docs: list[tuple[object, int, int, np.ndarray]] = []
        self.size = 0

    def add(self, key, before: int, total: int, ids: np.ndarray) -> None:
        self.docs.append((key, before, total, ids))
        self.size += len(ids)

    def pack(self, closes: np.ndarray, max_len: int, last: bool):
        """Pieces (key, start, length, crc, total, sequence, offset) of the closed windows; what remains stays."""
        if not self.docs:
            return [], 0
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        at, penalty = cut_points(ids, ends, closes, max_len)
        cuts = best_cuts(at.tolist(), penalty.tolist(), max_len)
        if not last:
            cuts.pop()
        upto = cuts[-1] if cuts else 0
        raw, pieces, c = ids.astype("<u4"), [], 0
        docs, self.docs, self.size = self.docs, [], 0
        begin = 0
        for (key, before, total, own), end in zip(docs, ends.tolist(), strict=True):
            a = begin
            while a < min(end, upto):
                while cuts[c] <= a:
                    c += 1
                b = min(end, cuts[c])
                pieces.append((key, before + a - begin, b - a, zlib.crc32(raw[a:b].tobytes()), total, c, a - (cuts[c - 1] if c else 0)))
                a = b
            if a < end:
                self.add(key, before + a - begin, total, own[a - begin :])
            begin = end
        return pieces, len(cuts)


def pack(docs: DataFrame, path: str, max_len: int = 1024, end_id: int = 0, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then ``end_id``; null and empty texts are that one
    id. Repeated rows are packed as often as they occur, other columns are ignored,
    an empty table gives no rows. sequence_id is unique: the number of the task times
    2**33 plus that of the sequence in it. A lost task is packed again alike.
    keep: whether a Python worker keeps the ids of pieces for its next tasks.
    """

    def run(batches):
        coder, closes = tokens.encoder(path, "bytes"), sentence_ends(path)
        tail = np.array([end_id], "<u4").tobytes()
        made, segment = TaskContext.get().partitionId() << 33, _Segment()

        def flush(last: bool):
            nonlocal made
            pieces, n = segment.pack(closes, max_len, last)
            columns = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
            arrays = [pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:5])]
            arrays += [pa.array([made + x for x in columns[5]], pa.int64()), pa.array(columns[6], pa.int64())]
            made += n
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in slices(batch, "text", 2 << 20):
                blobs = coder.encode(part.column("text").fill_null("").to_pylist())
                for key, blob in zip(part.column("doc_id").to_pylist(), blobs, strict=True):
                    ids = np.frombuffer(blob + tail, "<u4")
                    segment.add(key, 0, len(ids), ids)
                if segment.size >= SEGMENT:
                    yield flush(False)
        if segment.docs:
            yield flush(True)
        if not keep:
            coder.forget()

    schema = f"doc_id {ids_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)

"""SimHash near-duplicates by anchor points of covering codes.

A fingerprint has 64 bits; two of them link at two or fewer differing bits. The bits
are cut into block A (31) and block B (33). Of two linked fingerprints, either A
differs in at most one bit, or B doesn't differ.

* Block A: the anchors are the 2**26 words of the Hamming code [31, 26]. It is
  perfect with covering radius 1, so a fingerprint within 1 of another lies within
  radius + threshold = 2 of the other's nearest anchor. A fingerprint is replicated
  to all anchors within 2: at most 16.
* Block B: threshold 0, so each of its values is an anchor of radius 0: one replica.

Equal fingerprints are one class, so at most 17 rows a class are shuffled, however
many copies there are. An anchor with more than ``MOST`` classes is crowded and split by
a second code on the block that its own code leaves out (B for an anchor of block A,
where linked members differ in at most two bits; A for one of block B). That block is
cut alike: 15 bits with the Hamming code [15, 11], whose anchors within 1 + 1 take at
most 8 replicas, and the rest, matched exactly. What is crowded even then is dealt into
blocks of ``MOST`` classes, and each pair of blocks is compared in a task of its own. So
no anchor is gathered whole, and none is cut short. Each comparison reports a spanning
forest of its links, not all pairs; the components are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import ids_type, slices, stored
from strandframe.llm.components import components

WORDS, SEED, THRESHOLD = 3, 42, 2
A_BITS, SECOND_BITS = 31, 15
#: Classes of an anchor, or of a block of one, that are compared at once.
MOST = 256
#: Ids that go are broadcast up to this size.
SMALL_BYTES = 64 << 20
_A_MASK, _EXACT = (1 << A_BITS) - 1, 1 << 62


def fingerprint(raw: bytes, size: int = WORDS) -> int:
    """The fingerprint of a text in UTF-8; without words it is zero."""
    words = raw.lower().split()  # on bytes: A-Z only; space and tab to carriage return
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)]
    rows = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed integer."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own = [fingerprint((x or "").encode(), size) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(own, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids_type(docs)}, fp long")


def near_codewords(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(codeword, place in ``words``) of all words of the Hamming code of ``width`` bits (a power of two less one) within 2 of each."""
    s = np.zeros(len(words), np.int64)  # the exclusive or of the numbers, from 1, of the set bits
    for k in range(width):
        s ^= np.where((words >> k) & 1, k + 1, 0)
    flip = np.where(s > 0, np.left_shift(1, np.maximum(s, 1) - 1), 0)
    found, own = [words ^ flip], [np.arange(len(words))]  # the nearest
    for i in range(1, width + 1):  # two bits whose numbers give the syndrome
        j = i ^ s
        at = np.flatnonzero((s > 0) & (j > i))
        found.append(words[at] ^ (1 << (i - 1)) ^ np.left_shift(1, j[at] - 1))
        own.append(at)
    return np.concatenate(found), np.concatenate(own)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, fingerprint) of signed 64-bit fingerprints."""
    bits = fps.view(np.uint64)
    found, own = near_codewords((bits & np.uint64(_A_MASK)).astype(np.int64), A_BITS)
    exact = (bits >> np.uint64(A_BITS)).astype(np.int64) | _EXACT
    return np.concatenate([found, exact]), np.concatenate([fps[own], fps])


def second_anchors(at: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(second anchor, place) of the members ``fps`` of the anchors ``at``."""
    bits = fps.view(np.uint64)
    rest = np.where(at & _EXACT, bits & np.uint64(_A_MASK), bits >> np.uint64(A_BITS)).astype(np.int64)
    found, own = near_codewords(rest & ((1 << SECOND_BITS) - 1), SECOND_BITS)
    return np.concatenate([found, (rest >> SECOND_BITS) | _EXACT]), np.concatenate([own, np.arange(len(fps))])


def forest(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, 2 * MOST or fewer."""
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= threshold
    left, out = np.ones(len(fps), bool), []
    while left.any():
        root = int(left.argmax())
        left[root] = False
        front = [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & left).tolist():
                left[j] = False
                out.append((int(fps[i]), int(fps[j])))
                front.append(j)
    return out


def _visits(fps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 4096):
                at, own = anchors(np.asarray(batch.column("fp").slice(a, 4096)))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own)], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def _split(crowded: DataFrame) -> DataFrame:
    """(anchor, second, fp) of (anchor, fp)."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 4096):
                at, own = (np.asarray(batch.column(c).slice(a, 4096)) for c in ("anchor", "fp"))
                second, place = second_anchors(at, own)
                yield pa.RecordBatch.from_arrays([pa.array(at[place]), pa.array(second), pa.array(own[place])], ["anchor", "second", "fp"])

    return crowded.select("anchor", "fp").mapInArrow(run, "anchor long, second long, fp long")


def _compared(groups: DataFrame) -> DataFrame:
    """(a, b): forests of the links in each array ``fps``."""

    def run(batches):
        for batch in batches:
            found = [x for group in batch.column("fps").to_pylist() for x in forest(np.array(sorted(group), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def _sized(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``n``, the classes that share the keys, to those that aren't alone; stored."""
    sizes = visits.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return stored(visits.join(sizes, keys), "shared")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``: links whose components are those of all links."""
    shared = _sized(stored(_visits(fps), "visits"), ["anchor"])
    few = F.col("n") <= MOST
    found = _compared(shared.where(few).groupBy("anchor").agg(F.collect_list("fp").alias("fps")))
    crowded = shared.where(~few)
    if not crowded.isEmpty():
        split = _sized(stored(_split(crowded), "split"), ["anchor", "second"])
        found = found.union(_compared(split.where(few).groupBy("anchor", "second").agg(F.collect_list("fp").alias("fps"))))
        parts = F.ceil(F.col("n") / F.lit(MOST)).cast("int")
        dealt = split.where(~few).withColumn("own", F.pmod(F.xxhash64("fp"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        blocks = dealt.groupBy("anchor", "second", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
        found = found.union(_compared(blocks.agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id of the component.

    Null, empty and blank texts have fingerprint zero and are linked like any other.
    Repeated rows stay. Null doc_ids count last: a component of these alone has null.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(classes))
    member = found.join(classes.withColumnRenamed("fp", "node"), "node")
    ids = member.groupBy("label").agg(F.min("least").alias("component_id"))
    named = found.join(ids, "label").select(F.col("node").alias("fp"), "component_id")
    of_class = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    of_class = stored(of_class, "components")  # so that a fingerprint with many copies meets it in a join that Spark can split
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` with one document of each component of near-duplicates."""
    return one_of_each(docs, near_duplicates(docs, size))


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component of ``named`` (doc_id, component_id): the one with the smallest doc_id.

    Rows without doc_id stay. Of rows that repeat a doc_id, one stays.
    """
    is_kept = F.col("doc_id") == F.col("component_id")
    found = named.where("doc_id is not null").groupBy("doc_id").agg(F.count_if(is_kept).alias("n"))
    found = stored(found, "near")
    gone = found.where("n = 0").select("doc_id")
    held = gone.agg(F.sum(F.octet_length(F.col("doc_id").cast("string")) + 32)).first()[0] or 0
    if held <= SMALL_BYTES:
        gone = F.broadcast(gone)  # its size was just measured; larger ones are joined by a shuffle
    kept = docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    if found.where("n > 1").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).union(kept.where("doc_id is null"))
    return kept

"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

Shingles are of five words. Texts with equal sets are one class. They are found by
SimHash and anchor points of covering codes, as in ``simhash``, with settings for this
similarity, at which a bit of two fingerprints differs with a probability of 0.15:

1. A class has a fingerprint of ``BITS`` bits, which is cut into ``BLOCKS`` blocks, drawn
   bits each. A block is covered by perfect codes, the Hamming codes of ``CODES`` bits;
   its anchor is made of their codewords within the covering radius, of which there is
   one. Two classes of similarity 0.8 share no anchor with a probability of about 1e-4.
2. Classes that share an anchor and differ in at most ``RADIUS`` of the first
   64 * ``CHECKED`` bits link. The components of these links are clusters. Links of the
   first blocks come first; what they join is one node for the other blocks, which look
   for links between different nodes only, and each comparison reports every node once, with
   the least of its component. So a large group isn't linked again by every block.
3. Within a cluster, pairs are compared by their shingles, so none below 0.8 links: all
   classes with the least of them, and clusters that this leaves in several components
   in full, ``MOST`` classes by ``MOST`` at a time, so that a task's size is bounded.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm import simhash
from strandframe.llm.common import ids_type, slices, stored
from strandframe.llm.components import components

WORDS, SEED = 5, 43
#: Similarity as a fraction, so that the comparison is exact.
LEAST = (4, 5)
#: Bits of a fingerprint; its first words of 64 bits, which go with an anchor; differing bits of these that link.
BITS, CHECKED, RADIUS = 1024, 3, 54
#: Blocks of a fingerprint, and the lengths of the Hamming codes that cover one.
BLOCKS, CODES = 128, (15, 7)
#: Blocks whose links are joined before the others are looked at.
FIRST = 8
#: Links that a task takes at once to leave the fewest that have their components, about.
LINKS = 1 << 20
#: Classes whose anchors are dealt to one bucket of a block, about, and that a task sends at once.
BUCKET, SENT = 50_000, 4096
#: Classes of an anchor that are compared pair by pair; more are compared from a root on, which skips what is linked.
FEW = 64
#: Classes of a cluster on either side of a comparison in full.
MOST = 256
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64, dtype=np.uint64)
_PLACES = np.array([np.random.default_rng((SEED, k)).permutation(BITS)[: sum(CODES)] for k in range(BLOCKS)])
_VISIT = np.dtype([("anchor", "<u4"), ("key", "<i8"), ("fp", "<u8", CHECKED)])


def shingles(raw: bytes) -> np.ndarray:
    """The distinct hashed shingles of a text in UTF-8, sorted; a text of fewer words is one shingle, one without words none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + WORDS]), SEED) for i in range(max(1, len(words) - WORDS + 1))], np.uint64))


def key_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashed shingles, as words of 64 bits: a bit is 1 if it is in over half of them."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(own), 255):  # so that the sums of a bit, which are added eight at once, fit a byte
        x = own[a : a + 255, None] ^ _DRAWN
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)


def anchors(prints: np.ndarray, blocks: range = range(BLOCKS)) -> np.ndarray:
    """The anchor of each of some blocks (columns) of fingerprints (rows)."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little").T
    out = np.zeros((len(prints), len(blocks)), np.uint32)
    for column, places in enumerate(_PLACES[blocks.start : blocks.stop]):
        at = 0
        for width in CODES:
            word, syndrome = np.zeros(len(prints), np.uint32), np.zeros(len(prints), np.uint32)
            for k in range(width):
                bit = bits[places[at + k]]
                word |= bit.astype(np.uint32) << np.uint32(k)
                syndrome ^= bit * np.uint32(k + 1)
            word ^= np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1)), np.uint32(0))  # the codeword within 1
            out[:, column] |= word << np.uint32(at)
            at += width
    return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the nodes ``a`` with ``b``: ``root``, the smallest node of each node's component, is changed in place."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != (up := root[root])).any():
            root[:] = up


def stars(keys: np.ndarray, root: np.ndarray) -> np.ndarray:
    """(smallest key of the component, key) of the nodes that aren't the smallest; ``keys`` ascend."""
    of = np.flatnonzero(root != np.arange(len(keys)))
    return np.stack([keys[root[of]], keys[of]], axis=1)


def links(visits: np.ndarray) -> np.ndarray:
    """Pairs of keys (columns), the least first, of ``_VISIT`` rows: stars whose components are those of all links between rows that share an anchor."""
    visits = visits[np.argsort(visits["anchor"], kind="stable")]
    prints = np.ascontiguousarray(visits["fp"])
    keys, node = np.unique(visits["key"], return_inverse=True)
    root = np.arange(len(keys))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(visits["anchor"]) != 0]))
    sizes = np.diff(np.concatenate([starts, [len(visits)]]))

    def near(a, b):
        return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1) <= RADIUS

    few = sizes <= FEW
    after = (np.repeat(starts + sizes, sizes) - np.arange(len(visits)) - 1) * np.repeat(few, sizes)  # members of the group that follow
    at, k = np.flatnonzero(after), 1
    while len(at):
        apart = at[root[node[at]] != root[node[at + k]]]
        hit = apart[near(apart, apart + k)]
        joined(root, node[hit], node[hit + k])
        k += 1
        at = at[after[at] >= k]
    for start, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
        left = np.arange(start, start + size)
        while len(left):
            own = root[node[left]] == root[node[left[0]]]
            front, left = left[own].tolist(), left[~own]
            while front and len(left):
                i = front.pop()
                hit = left[near(left, [i])]
                joined(root, node[hit], node[[i] * len(hit)])
                own = root[node[left]] == root[node[i]]
                front += left[own].tolist()
                left = left[~own]
    return stars(keys, root)


def thinned(found: np.ndarray) -> np.ndarray:
    """Stars that have the components of links (columns)."""
    keys, node = np.unique(found, return_inverse=True)
    root = np.arange(len(keys))
    joined(root, *node.reshape(found.shape).T)
    return stars(keys, root)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def forest(keys: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among sets whose components, with the labels, are those of all links."""
    sizes = np.array([len(x) for x in sets])
    places = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(places.max()) + 1, bool)
    names = np.array(labels)
    left, out = np.ones(len(sets), bool), []
    while left.any():
        first = names == names[left.argmax()]
        front = np.flatnonzero(first).tolist()
        left &= ~first
        while front and left.any():
            i = front.pop()
            own = places[starts[i] : starts[i + 1]]
            marked[own] = True
            both = np.add.reduceat(marked[places].astype(np.int64), starts[:-1])
            marked[own] = False
            for j in np.flatnonzero(left & (LEAST[1] * both >= LEAST[0] * (sizes + sizes[i] - both))).tolist():
                out.append((keys[i], keys[j]))
                if left[j]:
                    taken = names == names[j]
                    front += np.flatnonzero(taken & left).tolist()
                    left &= ~taken
    return out


def _links(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _columns(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, k], pa.int64()) for k in (0, 1)], ["a", "b"])


def _components(found: DataFrame) -> DataFrame:
    """``components`` of links (a, b), which are stored, after each task has thinned ``LINKS`` of them, about."""

    def run(batches):
        found = [np.stack([np.asarray(batch.column(c)) for c in ("a", "b")], axis=1) for batch in batches]
        yield _columns(thinned(np.concatenate([np.zeros((0, 2), np.int64), *found])))

    parts = -(-max(1, found.count()) // LINKS)
    return components(found.repartition(parts).mapInArrow(run, "a long, b long"))


def _visits(classes: DataFrame, parts: int, blocks: range) -> DataFrame:
    """(block, part, visits): rows of ``_VISIT`` of the classes' anchors, by block and part of its anchors."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), SENT):
                some = batch.slice(a, SENT)
                prints = np.frombuffer(b"".join(some.column("fp").to_pylist()), np.uint64).reshape(len(some), -1)
                at = anchors(prints, blocks)
                made = np.empty(len(some), _VISIT)
                made["key"], made["fp"] = np.asarray(some.column("key")), prints[:, :CHECKED]
                for block, own in zip(blocks, at.T, strict=True):
                    made["anchor"], part = own, own % parts
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                    rows = [(p, made[order[x:y]].tobytes()) for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if x < y]
                    arrays = [pa.array([block] * len(rows), pa.int32()), pa.array([p for p, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "part", "visits"])

    return classes.select("key", "fp").mapInArrow(run, "block int, part int, visits binary")


def _near(visits: DataFrame) -> DataFrame:
    """(a, b) of keys: the links of each block's parts."""

    def run(batches):
        def flush(held):
            return _columns(links(np.frombuffer(b"".join(held), _VISIT)))

        now, held = None, []
        for batch in batches:
            for block, part, rows in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "visits")), strict=True):
                if (block, part) != now:
                    if held:
                        yield flush(held)
                    now, held = (block, part), []
                held.append(rows)
        if held:
            yield flush(held)

    return visits.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(run, "a long, b long")


def _clusters(prints: DataFrame) -> DataFrame:
    """(cluster, key): the components of the links of classes (key, fp), without classes that have none; cluster is the smallest key."""
    parts = -(-max(1, prints.count()) // BUCKET)
    near = stored(_near(_visits(prints, parts, range(FIRST))).distinct(), "near")
    first = _components(near)
    joined = prints.join(first.withColumnRenamed("node", "key"), "key", "left").select(F.coalesce("label", "key").alias("key"), "fp")
    apart = stored(_near(_visits(joined, parts, range(FIRST, BLOCKS))).distinct(), "near")
    rest = _components(apart)
    named = first.join(rest.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label", "left").select(F.coalesce("cluster", "label").alias("cluster"), F.col("node").alias("key"))
    new = rest.join(first, "node", "left_anti").select(F.col("label").alias("cluster"), F.col("node").alias("key"))
    return stored(named.union(new), "clusters")


def _against_least(shared: DataFrame, texts: DataFrame) -> DataFrame:
    least = shared.groupBy("cluster").agg(F.min("key").alias("a"))
    pairs = shared.join(least, "cluster").where("a <> key").select("a", F.col("key").alias("b")).distinct()
    pairs = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text")), "b")

    def compare(batches):
        of = lru_cache(64)(lambda text: shingles(text.encode()))
        for batch in batches:
            for part in slices(batch, "text"):
                a, b, left, right = (part.column(c).to_pylist() for c in ("a", "b", "text_a", "text"))
                yield _links([(a[i], b[i]) for i in range(len(a)) if similar(of(left[i]), of(right[i]))])

    return pairs.mapInArrow(compare, "a long, b long")


def _in_full(shared: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame:
    named = shared.where("n > 2").join(found.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    named = stored(named, "named")
    several = named.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cluster")
    parts = F.ceil(F.col("n") / F.lit(MOST)).cast("int")
    dealt = named.join(several, "cluster").withColumn("own", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    groups = dealt.groupBy("cluster", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.array_sort(F.collect_list(F.struct("key", "label"))).alias("members"))
    groups = groups.where(F.size("members") > 1).select(F.xxhash64("members").alias("g"), "members").dropDuplicates(["g"])
    each = groups.select("g", F.explode("members").alias("m")).select("g", "m.key", "m.label").join(texts, "key")
    whole = each.groupBy("g").agg(F.collect_list(F.struct("key", "label", "text")).alias("members")).select("members")

    def compare(batches):
        for batch in batches:
            for k in range(len(batch)):
                own = batch.column("members").slice(k, 1).to_pylist()[0]
                yield _links(forest([m["key"] for m in own], [m["label"] for m in own], [shingles(m["text"].encode()) for m in own]))

    return whole.mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id; component_id is the smallest doc_id of the component.

    Null, empty and blank texts are one class. Repeated rows stay.
    """

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own = [shingles((x or "").encode()) for x in part.column("text").to_pylist()]
                arrays = [part.column("doc_id"), pa.array([key_of(x) for x in own], pa.int64()), pa.array([fingerprint(x).tobytes() if len(x) else None for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "fp"])

    def of_class(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array([k == key_of(shingles((x or "").encode())) for k, x in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True)], pa.bool_()))

    own = docs.where("doc_id is not null").select("doc_id", "text")
    rows = stored(own.mapInArrow(sketch, f"doc_id {ids_type(docs)}, key long, fp binary"), "sketches")
    classes = stored(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "classes")
    prints = classes.where("fp is not null")  # texts without words are one class
    clusters = _clusters(prints)
    shared = stored(clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster").select("cluster", "key", "n"), "shared")
    wanted = shared.select("key").distinct().join(classes.select("key", F.col("least").alias("doc_id")), "key")
    texts = wanted.join(own, "doc_id").select("key", "text").mapInArrow(of_class, "key long, text string")  # a doc_id may repeat with another text
    texts = stored(texts.dropDuplicates(["key"]), "texts")
    first = stored(_against_least(shared, texts), "first")
    rest = stored(_in_full(shared, texts, _components(first)), "rest")
    found = _components(first.union(rest))
    ids = found.join(classes.select(F.col("key").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("component_id"))
    named = found.join(ids, "label").select(F.col("node").alias("key"), "component_id")
    of = stored(classes.select("key", "least").join(named, "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "components")
    return rows.select("doc_id", "key").join(of, "key").select("doc_id", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component, as ``simhash.one_of_each`` says."""
    return simhash.one_of_each(docs, near_copies(docs))

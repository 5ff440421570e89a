"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

The suffixes that are sorted are those at sampled positions. A window is a string of
LENGTH bytes; its anchor is its leftmost smallest hash of ``GRAM`` bytes, so windows
with equal bytes have their anchors at equal offsets, and the windows of one anchor
are consecutive. About two in LENGTH positions are anchors. With o the offset of the
anchor in a window, the window is the last o bytes before the anchor and the first
LENGTH - o from it; windows are equal exactly if both parts are.

* Forward suffixes (zone 0, o up to HALF): sorted by the bytes from the anchor on.
* Backward suffixes (zone 1, larger o): by the bytes before it, last first.

All windows of a zone share a core at the anchor (``core``). Suffixes whose core
occurs once in the corpus have no repeated window: counts of core hashes leave them
out, and hash collisions only leave too many in.

The others go through a distributed merge sort. Each task sorts its suffixes into one
run for each bucket of core hashes, front-codes it (length of the prefix shared with
the suffix before, and the rest), and sends it. A bucket's runs are merged by a loser
tree that keeps, for each run's head, the length of the prefix shared with the last
output: heads with different lengths are ordered without touching their bytes, and
bytes that are known to be equal are never compared again. The merge yields the
sorted suffixes and their common prefix lengths. From these lengths and those of the
other parts, sorted alike, equal parts of any length are numbered, and a window is
repeated exactly if another has both its numbers.

Equal texts are represented by one of them throughout. Equal suffixes with equal other
parts in one task are known to be repeated at once: the task reports their bytes and
sends one of them, marked as such. So however often a passage occurs, a bucket gets it
once from each task. Within a bucket, such entries are merged again.

A core with more than ``HOT`` suffixes isn't dealt whole: its offsets are cut into
``PARTS`` zones, whose suffixes share longer cores. Those with equal parts are counted by
digests, so that one of them stands for all; what is left goes to buckets by the longer
cores. Where even these have more than HOT suffixes, their windows are counted one by one,
by digests of 128 bits. So a task never holds more than HOT suffixes of a core, but for
hash collisions, and no suffix is left out.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import byte_view, forget, fresh, ids_type, slices, stored

LENGTH = 400
#: Bytes of repeated passages that are reported, though they are too short to be removed: about 50 short words.
PASSAGE = 240
GRAM = 16
#: Keys are broadcast up to this size, in bytes, and what one takes.
SMALL_BYTES, KEY_BYTES = 64 << 20, 64
#: Largest offset of zone 0.
HALF = (LENGTH - GRAM) // 2
#: Entries of a bucket, about.
BUCKET = 20_000
#: Suffixes of a core that are dealt to one bucket, and zones that the offsets of either half are cut into beyond.
HOT, PARTS = 4096, 8
#: Bytes of entries after which a task sends its runs.
RUN_BYTES = 48 << 20
#: Bytes of runs that it sends at once, about.
SENT_BYTES = 2 << 20
_OWNER = np.dtype([("key", "V16"), ("pos", "<i4"), ("lo", "<i2"), ("hi", "<i2")])


def window_anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text of at least ``length`` bytes: anchor positions, and each one's smallest and largest offset."""
    n, width = len(raw), length - GRAM + 1
    words = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(raw).data, strides=(1,))
    h = words[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += words[GRAM - 8 :]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(len(h), dtype=np.uint64)  # so the leftmost of equal hashes is the smallest
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = h
    grid = padded.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:], [windows]]) - 1
    pos = at[first]
    return pos, pos - last, pos - first


@lru_cache
def zone_limits(length: int = LENGTH) -> tuple[tuple[int, int], ...]:
    """Smallest and largest offset of the two zones, and of the finer ones that crowded cores are cut into."""
    half = (length - GRAM) // 2
    whole = (0, half), (half + 1, length - GRAM)
    step = -(-(half + 1) // PARTS)
    return *whole, *((x, min(x + step - 1, high)) for low, high in whole for x in range(low, high + 1, step))


def forward(zone: int, length: int = LENGTH) -> bool:
    """Whether a zone's suffixes are sorted by the bytes from the anchor on."""
    return zone_limits(length)[zone][1] <= (length - GRAM) // 2


def core(data: bytes, zone: int, pos: int, length: int = LENGTH) -> bytes:
    """What all windows of an anchor in a zone share."""
    low, high = zone_limits(length)[zone]
    return data[pos - low : pos + length - high]


def parts(data: bytes, zone: int, pos: int, length: int = LENGTH) -> tuple[bytes, bytes]:
    """The sorted part of a suffix and the other one, cut to what windows of the zone hold."""
    low, high = zone_limits(length)[zone]
    after, before = data[pos : pos + length - low], data[max(0, pos - high) : pos][::-1]
    return (after, before) if forward(zone, length) else (before, after)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes needn't be looked at."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    return m - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def write_run(entries: list[tuple[bytes, bytes, bytes]]) -> tuple[bytes, list[bytes]]:
    """A sorted, front-coded run of (sorted part, other part, owner), and the owners of entries that occur more than once.

    Of these, the run has one, whose owner stands twice.
    """
    entries.sort(key=lambda e: (e[0], e[1]))
    shared, rest, other, owners, known = [], [], [], [], []
    last = None
    for first, second, own in entries:
        if last is not None and last == (first, second):
            if len(owners[-1]) == _OWNER.itemsize:
                known.append(owners[-1])
                owners[-1] *= 2
            known.append(own)
            continue
        shared.append(common(last[0], first) if last else 0)
        rest.append(first[shared[-1] :])
        other.append(second)
        owners.append(own)
        last = (first, second)
    counts = np.array([shared, [*map(len, rest)], [*map(len, other)], [len(x) // _OWNER.itemsize for x in owners]], "<i4")
    body = b"".join([len(shared).to_bytes(8, "little"), counts.tobytes(), *rest, *other, *owners])
    return zstandard.ZstdCompressor(level=1).compress(body), known


def read_run(blob: bytes):
    """(prefix shared with the entry before, sorted part, other part, owners), in order."""
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(body[:8], "little")
    shared, rest, other, owners = np.frombuffer(body[8 : 8 + 16 * n], "<i4").reshape(4, n)
    a = 8 + 16 * n
    b = a + int(rest.sum())
    c = b + int(other.sum())
    first = b""
    for k, x, y, z in zip(shared.tolist(), rest.tolist(), other.tolist(), (owners * _OWNER.itemsize).tolist(), strict=True):
        first = first[:k] + body[a : a + x]
        yield k, first, body[b : b + y], body[c : c + z]
        a, b, c = a + x, b + y, c + z


def merge_runs(runs):
    """Merges runs by a loser tree; yields the same, with prefixes shared with the entry before in the merged order."""
    sources = [iter(x) for x in runs]
    k = 1
    while k < len(sources):
        k *= 2
    heads: list = [next(s, None) for s in sources] + [None] * (k - len(sources))
    known = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = common(x[1], y[1], known[a])
        if h == len(x[1]) or (h < len(y[1]) and x[1][h] < y[1][h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = [0] * (2 * k)
    winners[k:] = range(k)
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while heads and heads[best] is not None:
        entry = heads[best]
        yield known[best], *entry[1:]
        heads[best] = following = next(sources[best], None)
        known[best] = following[0] if following is not None else 0
        node = (best + k) // 2
        while node:  # as ``play``, in place
            other = losers[node]
            if (y := heads[other]) is not None:
                swap = True
                if following is not None:
                    mine, theirs = known[best], known[other]
                    if mine != theirs:
                        swap = mine < theirs
                    else:
                        x, z = following[1], y[1]
                        h = common(x, z, mine)
                        swap = h < len(x) and (h == len(z) or x[h] > z[h])
                        known[best if swap else other] = h
                if swap:
                    losers[node], best, following = best, other, y
            node //= 2


def repeated(zone: int, shared: np.ndarray, others: list[bytes], lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Of sorted entries: which offsets (columns, from the zone's smallest) are of repeated windows."""
    low, high = zone_limits(length)[zone]
    ahead = forward(zone, length)
    n = len(others)
    order = sorted(range(n), key=others.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    beside = np.array([0, *(common(others[a], others[b]) for a, b in zip(order, order[1:], strict=False))])
    hit = np.zeros((n, high - low + 1), bool)
    for o in range(max(low, int(lo.min())), min(high, int(hi.max())) + 1):
        at = np.flatnonzero((lo <= o) & (o <= hi))
        if len(at) < 2:
            continue
        need, rest = (length - o, o) if ahead else (o, length - o)
        number = np.cumsum(shared < need)[at] * (n + 1) + np.cumsum(beside < rest)[rank[at]]
        by = np.argsort(number, kind="stable")
        same = number[by][1:] == number[by][:-1]
        found = np.zeros(len(at), bool)
        found[by[1:]] |= same
        found[by[:-1]] |= same
        hit[at[found], o - low] = True
    hit[copies > 1] = True
    return hit


def _spans(zone: int, group: list[tuple], length: int):
    """(key, start, end) of the bytes that repeated windows of these sorted entries cover."""
    low = zone_limits(length)[zone][0]
    owners = [np.frombuffer(e[3], _OWNER) for e in group]
    lo, hi = (np.array([int(o[f][0]) for o in owners]) for f in ("lo", "hi"))
    hit = repeated(zone, np.array([0, *(e[0] for e in group[1:])]), [e[2] for e in group], lo, hi, np.array([len(o) for o in owners]), length)
    for own, row in zip(owners, hit, strict=True):
        for key, pos, a, b in own.tolist():
            line = row[a - low : b - low + 1]
            if line.all():
                yield key, pos - b, pos - a + length
            elif line.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], line, [False]]).astype(np.int8)))
                for x, y in edge.reshape(-1, 2).tolist():  # offsets a + x to a + y - 1
                    yield key, pos - a - y + 1, pos - a - x + length


def bucket_spans(zone: int, blobs: list[bytes], length: int = LENGTH, most: int = 1 << 15):
    """Merges the runs of a bucket and yields the spans of whole groups of suffixes with equal cores."""
    low, high = zone_limits(length)[zone]
    need = length - high if forward(zone, length) else low
    batch: list[tuple] = []
    group: list[tuple] = []
    places: dict[bytes, int] = {}

    def useful() -> bool:
        return len(group) > 1 or len(group[0][3]) > _OWNER.itemsize

    for shared, first, second, own in merge_runs([read_run(x) for x in blobs]):
        if group and shared < need:
            if useful():
                batch += group
            if len(batch) >= most:
                yield from _spans(zone, batch, length)
                batch = []
            group = []
        if group and shared == len(first) == len(group[-1][1]):
            if (k := places.get(second)) is not None:
                group[k] = (*group[k][:3], group[k][3] + own)
                continue
        else:
            places = {}
        places[second] = len(group)
        group.append((shared if group else 0, first, second, own))
    if group and useful():
        batch += group
    if batch:
        yield from _spans(zone, batch, length)


def joined(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The ranges [a, b) of each key of 16 bytes, those that overlap or touch as one."""
    if not len(a):
        return [], a, b
    halves = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
    order = np.lexsort((a, halves[:, 1], halves[:, 0]))
    halves, a, b = halves[order], a[order], b[order]
    other = np.concatenate([[True], (halves[1:] != halves[:-1]).any(axis=1)])
    base = np.cumsum(other) << 32
    reach = np.maximum.accumulate(base | b)  # the farthest end of a key so far
    first = np.flatnonzero(other | np.concatenate([[True], a[1:] > (reach[:-1] & 0xFFFFFFFF)]))
    raw = np.ascontiguousarray(halves[first]).tobytes()
    last = np.concatenate([first[1:], [len(a)]]) - 1
    return [raw[k : k + 16] for k in range(0, len(raw), 16)], a[first], reach[last] & 0xFFFFFFFF


def _key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _sampled(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc_id, n, zone, pos, lo, hi, hash): the sampled suffixes of texts that are long enough."""

    def run(batches):
        (_, top), (low, high) = zone_limits(length)[:2]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                raw, at = byte_view(part.column("text"))
                rows = []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    if b - a < length:
                        continue
                    data = raw[a:b].tobytes()
                    pos, lo, hi = window_anchors(raw[a:b], length)
                    zone = np.concatenate([np.zeros(int((lo <= top).sum()), np.int8), np.ones(int((hi >= low).sum()), np.int8)])
                    keep = np.concatenate([np.flatnonzero(lo <= top), np.flatnonzero(hi >= low)])
                    p = pos[keep]
                    x = np.where(zone == 0, lo[keep], np.maximum(lo[keep], low))
                    y = np.where(zone == 0, np.minimum(hi[keep], top), hi[keep])
                    digest = xxhash.xxh3_64_intdigest
                    from_, to = p - np.where(zone == 0, 0, low), p + length - np.where(zone == 0, top, high)  # as ``core``
                    hashes = np.array([digest(data[c:d], z) for z, c, d in zip(zone.tolist(), from_.tolist(), to.tolist(), strict=True)], np.uint64).view(np.int64)
                    rows.append((hashlib.md5(data).digest(), i, b - a, zone, p.astype(np.int32), x.astype(np.int16), y.astype(np.int16), hashes))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int8(), pa.int32(), pa.int16(), pa.int16(), pa.int64())
                    arrays = [pa.array(columns[0], pa.binary()), part.column("doc_id").take(pa.array(columns[1])), pa.array(columns[2], pa.int64())]
                    arrays += [pa.array(c, pa.list_(kind)) for c, kind in zip(columns[3:], kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "n", "zone", "pos", "lo", "hi", "hash"])

    schema = f"key binary, doc_id {ids_type(docs)}, n long, zone array<tinyint>, pos array<int>, lo array<smallint>, hi array<smallint>, hash array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _runs(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Of (text, _key, found): each task's sorted runs as (bucket, zone, run), and bytes it knows to repeat as (key, a, b)."""

    limits = [(low, high, forward(z, length)) for z, (low, high) in enumerate(zone_limits(length))]

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        size = 0

        def send():
            made: list[tuple] = []
            sent = 0
            repeats: list[bytes] = []
            for (zone, bucket), entries in sorted(held.items()):
                blob, known = write_run(entries)
                made.append((bucket, zone, blob))
                repeats += known
                sent += len(blob)
                if sent >= SENT_BYTES:
                    yield _row(dict(zip(("bucket", "zone", "run"), zip(*made, strict=True), strict=True)))
                    made, sent = [], 0
            if made:
                yield _row(dict(zip(("bucket", "zone", "run"), zip(*made, strict=True), strict=True)))
            if repeats:
                own = np.frombuffer(b"".join(repeats), _OWNER)
                pos = own["pos"].astype(np.int64)
                yield _row(dict(zip(("key", "a", "b"), joined(own["key"], pos - own["hi"], pos - own["lo"] + length), strict=True)))
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = part.column("found")
                counts = found.value_lengths().to_pylist()
                fields = found.flatten()
                each = zip(*(fields.field(x).to_pylist() for x in ("zone", "pos", "lo", "hi", "hash")), strict=True)
                for text, key, n in zip(part.column("text"), part.column("_key").to_pylist(), counts, strict=True):
                    data = text.as_py().encode()
                    for zone, pos, lo, hi, core_hash in islice(each, n):
                        low, high, ahead = limits[zone]
                        after, before = data[pos : pos + length - low], data[max(0, pos - high) : pos][::-1]  # as ``parts``
                        owner = key + struct.pack("<ihh", pos, lo, hi)
                        entry = (after, before, owner) if ahead else (before, after, owner)
                        held.setdefault((zone, core_hash % buckets), []).append(entry)
                        size += len(after) + len(before) + 200
                    if size >= RUN_BYTES:
                        yield from send()
                        size = 0
        yield from send()

    schema = pa.schema([("bucket", pa.int32()), ("zone", pa.int8()), ("run", pa.binary()), ("key", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])

    def _row(columns: dict) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    return docs.select("text", "_key", "found").mapInArrow(run, "bucket int, zone tinyint, run binary, key binary, a int, b int")


def _merged(runs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(key, a, b): bytes that repeated windows cover, of the sorted runs of each bucket."""

    def run(batches):
        def flush():
            keys, a, b = zip(*found, strict=True) if found else ([], [], [])
            columns = joined(np.frombuffer(b"".join(keys), "V16"), np.array(a, np.int64), np.array(b, np.int64))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int32()) for c in columns[1:])], ["key", "a", "b"])

        at, blobs, found = (0, 0), [], []
        for batch in batches:
            for b, z, blob in zip(batch.column("bucket").to_pylist(), batch.column("zone").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if (b, z) != at:
                    found += bucket_spans(at[1], blobs, length)
                    if len(found) >= 1 << 16:
                        yield flush()
                    at, blobs = (b, z), []
                blobs.append(blob)
        found += bucket_spans(at[1], blobs, length)
        yield flush()

    dealt = runs.where("run is not null").select("bucket", "zone", "run").repartition(buckets, "bucket", "zone").sortWithinPartitions("bucket", "zone")
    return dealt.mapInArrow(run, "key binary, a int, b int")


def _by_text(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key", "doc_id").agg(F.collect_list(F.struct("zone", "pos", "lo", "hi", "hash")).alias("found"))


def _with_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The texts that suffixes are of, as (text, _key, _d, found)."""
    right = found.select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"), "found")
    return docs.select("doc_id", "text", _key().alias("_key")).join(right, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("text", "_key", "_d", "found")


def _digested(with_text: DataFrame, length: int, single: bool) -> DataFrame:
    """Of each suffix: its parts in the finer zones as (key, doc_id, zone, pos, lo, hi, hash, digest, n), or its single windows as (key, a, digest, n).

    What a task meets several times it sends once, with the number of times as n; each
    place of it is then a row without a digest, known to repeat.
    """

    def finer(key, own, data, e):
        for zone, (low, high) in enumerate(zone_limits(length)[2:], 2):
            lo, hi = max(low, e["lo"]), min(high, e["hi"])
            if lo <= hi:
                first, second = parts(data, zone, e["pos"], length)
                digest = xxhash.xxh3_128_digest(bytes([zone]) + len(first).to_bytes(4, "little") + first + second)
                yield key, own, zone, e["pos"], lo, hi, int(np.uint64(xxhash.xxh3_64_intdigest(core(data, zone, e["pos"], length), zone)).view(np.int64)), digest

    def windows(key, own, data, e):
        for a in range(e["pos"] - e["hi"], e["pos"] - e["lo"] + 1):
            yield key, a, xxhash.xxh3_128_digest(data[a : a + length])

    names = ["key", "a", "digest", "n"] if single else ["key", "doc_id", "zone", "pos", "lo", "hi", "hash", "digest", "n"]
    kinds = {"key": pa.binary(), "a": pa.int32(), "digest": pa.binary(), "zone": pa.int8(), "pos": pa.int32(), "lo": pa.int16(), "hi": pa.int16(), "hash": pa.int64(), "n": pa.int64()}
    each = windows if single else finer

    def run(batches):
        held: dict[bytes, list] = {}
        places: list[tuple] = []

        def flush(kind):
            places.extend((*row, n) for row, n in held.values())
            places.extend((*row[:-1], None, 0) for row, n in held.values() if n > 1)
            columns = zip(*places, strict=True) if places else [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, kind[x]) for x, c in zip(names, columns, strict=True)], names)
            held.clear()
            places.clear()
            return made

        kind = kinds
        for batch in batches:
            kind = {**kinds, "doc_id": batch.schema.field("_d").type}
            for part in slices(batch, "text", 1 << 20):
                for text, key, own, found in zip(*(part.column(c).to_pylist() for c in ("text", "_key", "_d", "found")), strict=True):
                    data = text.encode()
                    for e in found:
                        for row in each(key, own, data, e):
                            if (first := held.setdefault(row[-1], [row, 0]))[1]:
                                places.append((*row[:-1], None, 0))
                            first[1] += 1
                        if len(held) + len(places) >= 1 << 16:
                            yield flush(kind)
        if held:
            yield flush(kind)

    types = {"key": "binary", "a": "int", "digest": "binary", "doc_id": ids_type(with_text, "_d"), "zone": "tinyint", "pos": "int", "lo": "smallint", "hi": "smallint", "hash": "long", "n": "long"}
    return with_text.mapInArrow(run, ", ".join(f"{x} {types[x]}" for x in names))


def _of_crowded(docs: DataFrame, entries: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of the suffixes of crowded cores: those that buckets are still to compare, in finer zones, and spans that are known to repeat."""
    fine = stored(_digested(_with_text(docs, _by_text(entries)), length, False), "fine")
    columns = entries.columns
    alike = fine.where("n > 0").groupBy("zone", "hash", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("key", "pos", "doc_id", "lo", "hi")).alias("one"))
    alike = stored(alike, "alike")  # suffixes with equal parts, by one of them
    elsewhere = fine.where("n = 1").join(alike.where("n > 1").select("digest"), "digest", "left_semi")
    known = fine.where("n = 0").unionByName(elsewhere).select("key", (F.col("pos") - F.col("hi")).cast("int").alias("a"), (F.col("pos") - F.col("lo") + length).cast("int").alias("b"))
    variants = stored(alike.groupBy("zone", "hash").agg(F.count("*").alias("variants")).where("variants > 1"), "variants")
    left = stored(alike.join(variants, ["zone", "hash"]).select("zone", "hash", "one.*", "variants"), "left")
    single = _digested(_with_text(docs, _by_text(left.where(F.col("variants") > HOT))), length, True)
    single = stored(single, "windows")
    again = stored(single.where("n > 0").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"), "again")
    single_known = single.where("n = 0").unionByName(single.where("n = 1").join(again, "digest", "left_semi")).select("key", "a", (F.col("a") + length).alias("b"))
    finer = stored(left.where(F.col("variants") <= HOT).select(columns), "finer")
    known = stored(known.union(single_known), "known")
    forget(fine, alike, variants, left, single, again)
    return finer, known


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans): by MD5 of a text, the byte ranges [a, b) that repeated strings cover; they may overlap.

    Texts without any don't occur. Texts shorter than ``length`` never do. Of texts
    that occur more than once, all bytes are covered.
    """
    spark = docs.sparkSession
    sampled = stored(_sampled(docs, length), "sampled")
    texts = stored(sampled.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n")), "texts")
    one = sampled.alias("s").join(texts.alias("t"), (F.col("s.key") == F.col("t.key")) & F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")))
    entries = one.select("s.key", "s.doc_id", F.explode(F.arrays_zip("s.zone", "s.pos", "s.lo", "s.hi", "s.hash")).alias("e"))
    entries = stored(entries.select("key", "doc_id", "e.*"), "entries")
    shared = entries.groupBy("zone", "hash").count().where("count > 1")
    shared = stored(shared, "cores")  # so that a core with many suffixes meets it in a join that Spark can split
    alike = entries.join(shared.where(F.col("count") <= HOT), ["zone", "hash"]).select(entries.columns)
    crowded, known = shared.where(F.col("count") > HOT), None
    if not crowded.isEmpty():
        finer, known = _of_crowded(docs, entries.join(crowded, ["zone", "hash"]).select(entries.columns), length)
        alike = alike.union(finer)
    found = stored(_by_text(alike), "found")
    n = found.agg(F.sum(F.size("found"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    runs = stored(_runs(_with_text(docs, found), buckets, length), "runs")
    covered = _merged(runs, buckets, length).union(runs.where("run is null").select("key", "a", "b"))
    covered = covered if known is None else covered.union(known)
    whole = texts.where("copies > 1").select("key", F.lit(0).alias("a"), F.col("n").cast("int").alias("b"))
    pieces = covered.join(whole.select("key"), "key", "left_anti").union(whole)
    spans = stored(pieces.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    forget(sampled, texts, entries, shared, found, runs, *([] if known is None else [finer, known]))
    return spans


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of the bytes; spans are sorted and disjoint."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """``docs`` and the spans of each text, and the name of that column."""
    key, name = fresh(docs, "_key"), fresh(docs, "_spans")
    spans = repeated_spans(docs, length).select(F.col("key").alias(key), F.col("spans").alias(name))
    return docs.withColumn(key, _key()).join(spans, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def _ranges(column) -> list[list[tuple[int, int]]]:
    return [union_of([(s["a"], s["b"]) for s in x] if x else []) for x in column.to_pylist()]


def _longest_run(spans) -> Column:
    """The length of the longest range that overlapping or touching spans make."""
    start = F.struct(F.lit(0).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("most"))

    def step(acc, x):
        a, b = F.when(x["a"] <= acc["b"], acc["a"]).otherwise(x["a"]), F.when(x["a"] <= acc["b"], F.greatest(acc["b"], x["b"])).otherwise(x["b"])
        return F.struct(a.alias("a"), b.alias("b"), F.greatest(acc["most"], b - a).alias("most"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["most"])


def nested_spans(docs: DataFrame, length: int, passage: int) -> tuple[DataFrame, DataFrame]:
    """``repeated_spans`` for ``length`` and for the shorter ``passage``.

    A repeated string of ``length`` bytes is covered by repeated strings of ``passage``
    bytes, so only texts in which these make a run of that length are looked at again.
    """
    short = repeated_spans(docs, passage)
    keys = stored(short.where(_longest_run(F.col("spans")) >= length).select("key"), "long")
    wanted = keys.withColumnRenamed("key", "_key")
    if keys.count() * KEY_BYTES <= SMALL_BYTES:
        wanted = F.broadcast(wanted)  # its size was just measured; more keys are joined by a shuffle
    again = docs.select("doc_id", "text").withColumn("_key", _key()).join(wanted, "_key", "left_semi")
    again = stored(again.select("doc_id", "text"), "again")
    long = repeated_spans(again, length)
    forget(keys, again)
    return long, short


def dedup_digests(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with ``passage`` n_passage_bytes.

    n_passage_bytes: how many bytes repeated strings of ``passage`` bytes cover, which
    shows repeated passages that are too short to be removed. Null texts are empty;
    empty and short texts lose nothing; repeated rows stay and count as separate
    documents; an empty table gives no rows.
    """
    if passage is None:
        found = repeated_spans(docs, length).withColumnRenamed("spans", "long")
    elif 2 * GRAM < passage <= length:
        long, short = nested_spans(docs, length, passage)
        found = short.withColumnRenamed("spans", "short").join(long.withColumnRenamed("spans", "long"), "key", "left")
    else:
        raise ValueError(f"a passage has more than {2 * GRAM} bytes, and at most {length}")
    wide = docs.select("doc_id", "text", _key().alias("key")).join(found, "key", "left").drop("key")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passage_bytes"] if passage else [])]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, spans in zip(part.column("text").to_pylist(), _ranges(part.column("long")), strict=True):
                    data = (text or "").encode()
                    rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
                arrays = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
                if passage:
                    arrays.append(pa.array([sum(b - a for a, b in x) for x in _ranges(part.column("short"))], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names)

    schema = f"doc_id {ids_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return wide.mapInArrow(run, schema + (", n_passage_bytes long" if passage else ""))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with each text cut; a character loses all its bytes if it loses one. n_chars, where there is one, is counted anew.

    No row is dropped; a null text stays null.
    """
    wide, name = _with_spans(docs, length)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = []
                for text, spans in zip(part.column("text").to_pylist(), _ranges(part.column(name)), strict=True):
                    if text is not None and spans:
                        data = text.encode()
                        spans = [(a - _inside(data, a), b + _left(data, b)) for a, b in spans]
                        text = without(data, union_of(spans)).decode()
                    texts.append(text)
                made = part.drop_columns([name])
                at = made.schema.get_field_index("text")
                columns = made.columns
                columns[at] = pa.array(texts, made.schema.field("text").type)
                yield pa.RecordBatch.from_arrays(columns, made.schema.names)

    cut = wide.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cut


def _inside(data: bytes, at: int) -> int:
    """Bytes back to the start of the character that ``at`` cuts."""
    k = 0
    while 0 < at - k < len(data) and data[at - k] & 0xC0 == 0x80:
        k += 1
    return k


def _left(data: bytes, at: int) -> int:
    """Bytes on to the end of the character that ``at`` cuts."""
    k = 0
    while at + k < len(data) and data[at + k] & 0xC0 == 0x80:
        k += 1
    return k

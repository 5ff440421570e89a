"""Documents scored by the cross-entropy difference of two n-gram models.

The background model is of the whole corpus, the target model of the documents that
are labelled good. Both have the same vocabulary: the ``VOCABULARY`` - 2 words with the
highest counts in the corpus, ties by the word, and one number for all others. Both are
bigram models interpolated with add-one unigrams.

A token's difference is its loss under the target model less that under the background
model, in nats; a document's score is the mean. The lower, the more like the target.

Counts cover all documents and are exact. Words and histories are arrays whose size
VOCABULARY fixes; bigrams grow with the corpus and stay in a distributed table. To score,
texts are cut into chunks of about ``CHUNK`` tokens; each chunk's distinct bigrams are
looked up in that table, and their counts meet the chunk's texts again in one task. The
table is dealt by a hash of the bigram into one part for ``PART_BYTES`` of text; sorted
bigrams and counts travel as packed arrays, one row for a part and a task or chunk.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import ids_type, slices, stored
from strandframe.plans.numbering import numbered

VOCABULARY = 1 << 16
#: Bigrams that a task holds before it counts them and passes them on.
SLOTS = 1 << 20
#: Tokens of texts that are scored together.
CHUNK = 1 << 18
PART_BYTES = 16 << 20
#: Weight of the bigram estimate, and the pseudo-count that holds it back for rare histories.
HELD = 8.0
#: Words that a task counts before it passes them on.
MOST_WORDS = 1 << 19
START = 1
#: The class of a count n: its power of two and the four bits after the highest.
_CLASS = "CAST(16 * (length(bin(n)) - 1) + shiftright(n * 16, length(bin(n)) - 1) - 16 AS INT)"


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _batches_of_texts(batches, columns):
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            yield tuple(part.column(c) for c in columns)


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """The ``size`` - 2 words of the highest counts, ties by the word; the driver gets no others."""

    def count(batches):
        seen: Counter = Counter()

        def send():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for (texts,) in _batches_of_texts(batches, ["text"]):
            for text in texts.to_pylist():
                seen.update(tokens_of(text))
            if len(seen) >= MOST_WORDS:
                yield send()
        yield send()

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.select("word", "n", F.expr(_CLASS).alias("class")), "words")
    sizes = {r["class"]: r["count"] for r in counts.groupBy("class").count().collect()}  # at most 16 * 63 rows
    room, least, edge = size - 2, None, None
    for k in sorted(sizes, reverse=True):
        if sizes[k] > room:
            edge = k
            break
        room, least = room - sizes[k], k
    chosen = [] if least is None else counts.where(F.col("class") >= least).select("word").collect()
    if edge is not None and room > 0:
        ranked = numbered(counts.where(F.col("class") == edge).select((-F.col("n")).alias("least_first"), "word"), ["least_first", "word"], "place")
        chosen += ranked.where(F.col("place") < room).select("word").collect()
    return sorted(bytes(r["word"]) for r in chosen)


@dataclass
class Numbers:
    """Numbers of words: 0 for others, 1 for the start of a text, then the vocabulary."""

    of: dict[bytes, int]

    def text(self, text: str | None) -> np.ndarray:
        get = self.of.get
        return np.array([START, *[get(w, 0) for w in tokens_of(text)]], np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in byte planes, compressed."""
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").reshape(n)


def _sorted_packed(values: np.ndarray) -> bytes:
    return _packed(np.diff(values, prepend=0))


def _sorted_unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw))


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(24)).astype(np.int64) % parts


def _by_part(grams: np.ndarray, parts: int) -> list[np.ndarray]:
    """Of sorted bigrams: the places of those of each part, in order."""
    own = part_of(grams, parts)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.searchsorted(own[order], np.arange(1, parts)))


def _counts(docs: DataFrame, sent, size: int, slots: int, parts: int) -> DataFrame:
    """(part, place, n, good, grams, counts) by task: counts of words and, from ``size``, of histories in rows without part; packed bigrams with counts (all, then the target's) in the others."""
    schema = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("good", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        numbers, total, held, n_held = Numbers(sent.value), np.zeros((2, 2 * size), np.int64), [], 0

        def send():
            marked = np.concatenate(held)
            held.clear()
            grams, at, n = np.unique(marked >> 1, return_inverse=True, return_counts=True)
            good = np.bincount(at[(marked & 1).astype(bool)], minlength=len(grams))
            found = [(p, _sorted_packed(grams[x]), _packed(np.concatenate([n[x], good[x]]))) for p, x in enumerate(_by_part(grams, parts)) if len(x)]
            return pa.RecordBatch.from_pylist([{"part": p, "grams": g, "counts": c} for p, g, c in found], schema)

        for texts, good in _batches_of_texts(batches, ["text", "_good"]):
            for row in (False, True):
                own = [numbers.text(t) for t, g in zip(texts.to_pylist(), good.to_pylist(), strict=True) if bool(g) == row]
                if own:
                    every = np.concatenate(own)
                    at = np.flatnonzero(every != START)
                    total[int(row)] += np.bincount(np.concatenate([every[at], size + every[at - 1]]), minlength=2 * size)
                    held.append((every[at - 1] * size + every[at]) * 2 + row)
                    n_held += len(at)
            if n_held >= slots:
                yield send()
                n_held = 0
        if held:
            yield send()
        total[0] += total[1]
        at = np.flatnonzero(total[0])
        none = [pa.nulls(len(at), pa.int64()), *[pa.nulls(len(at), pa.binary())] * 2]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(at), pa.array(total[0, at]), pa.array(total[1, at]), *none[1:]], schema=schema)

    return docs.mapInArrow(run, "part long, place long, n long, good long, grams binary, counts binary")


def _merged(counts: DataFrame) -> DataFrame:
    """(part, grams, counts) with one row a part."""

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                own = batch.column("found").slice(k, 1).to_pylist()[0]
                every = np.concatenate([_sorted_unpacked(x["grams"]) for x in own])
                each = np.concatenate([_unpacked(x["counts"]).reshape(2, -1) for x in own], axis=1)
                order = np.argsort(every, kind="stable")
                every = every[order]
                starts = np.flatnonzero(np.diff(every, prepend=-1))
                summed = np.add.reduceat(each[:, order], starts, axis=1) if len(every) else each
                arrays = [batch.column("part").slice(k, 1), pa.array([_sorted_packed(every[starts])], pa.binary()), pa.array([_packed(summed.reshape(-1))], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "grams", "counts"])

    found = counts.where("part is not null").groupBy("part").agg(F.collect_list(F.struct("grams", "counts")).alias("found"))
    return found.mapInArrow(run, "part long, grams binary, counts binary")


@dataclass
class Scorer:
    """Both models: probabilities and counts by vocabulary number, and the table of bigrams; row 0 of the background, row 1 of the target."""

    of: dict[bytes, int]
    unigram: np.ndarray  # 2 x size, probabilities
    history: np.ndarray  # 2 x size, counts
    bigrams: DataFrame  # part, and packed bigrams (history * size + word) and counts
    parts: int


def losses(ids: np.ndarray, grams: np.ndarray, counts: np.ndarray, unigram: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each token of ``ids`` (starts of texts have zero) under the background and the target; grams: sorted, with counts (2 x grams)."""
    out = np.zeros((2, len(ids)))
    at = np.flatnonzero(ids != START)
    before, now = ids[at - 1], ids[at]
    wanted = before * unigram.shape[1] + now
    place = np.minimum(np.searchsorted(grams, wanted), max(len(grams) - 1, 0))
    seen = grams[place] == wanted if len(grams) else np.zeros(len(at), bool)
    for m in (0, 1):
        have = history[m][before]
        pair = np.where(seen, counts[m][place], 0) if len(grams) else 0
        trust = have / (have + HELD)
        out[m, at] = -np.log(trust * pair / np.maximum(have, 1) + (1 - trust) * unigram[m][now])
    return out[0], out[1]


def fit(docs: DataFrame, good: DataFrame, size: int = VOCABULARY, slots: int = SLOTS) -> Scorer:
    """Models of ``docs`` (doc_id, text); good: doc_id of the target's documents, each once. The result doesn't depend on ``slots``."""
    spark = docs.sparkSession
    words = vocabulary(docs, size)
    of = {w: k + 2 for k, w in enumerate(words)}
    sent = spark.sparkContext.broadcast(of)
    marked = docs.select("doc_id", "text").join(good.select("doc_id", F.lit(True).alias("_good")), "doc_id", "left").select("text", "_good")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + n_bytes // PART_BYTES
    counts = stored(_counts(marked, sent, size, slots, parts), "counts")
    summed = counts.where("part is null").groupBy("place").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    single = np.zeros((2, 2 * size))
    for batch in summed.toArrow().to_batches():
        at = np.asarray(batch.column("place"))
        single[0, at], single[1, at] = np.asarray(batch.column("n")), np.asarray(batch.column("good"))
    used = len(words) + 2
    seen = single[:, :used] + 1.0
    seen[:, START] = 0
    unigram = np.zeros((2, size))
    unigram[:, :used] = seen / seen.sum(axis=1, keepdims=True)
    return Scorer(of, unigram, single[:, size:], stored(_merged(counts), "bigrams"), parts)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score of every row.

    Null, empty and blank texts have no tokens and zeros. Repeated rows stay.
    """
    context = docs.sparkSession.sparkContext
    words, tables = context.broadcast(scorer.of), context.broadcast((scorer.unigram, scorer.history))
    size, kind, parts = scorer.unigram.shape[1], ids_type(docs), scorer.parts

    def encode(batches):
        numbers, chunk = Numbers(words.value), TaskContext.get().partitionId() << 32
        keys, own, n = [], [], 0

        def send():
            arrays = [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.concat_arrays(keys)), pa.array([_packed(np.array([len(x) for x in own]))], pa.binary()), pa.array([_packed(np.concatenate(own))], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "doc_ids", "sizes", "ids"])

        for ids, texts in _batches_of_texts(batches, ["doc_id", "text"]):
            for k, text in enumerate(texts.to_pylist()):
                keys.append(ids.slice(k, 1))
                own.append(numbers.text(text))
                n += len(own[-1])
                if n >= CHUNK:
                    yield send()
                    chunk, keys, own, n = chunk + 1, [], [], 0
        if own:
            yield send()

    def distinct(ids):
        at = np.flatnonzero(ids != START)
        return np.unique(ids[at - 1] * size + ids[at])

    def wanted(batches):
        for batch in batches:
            for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                grams = distinct(_unpacked(raw))
                own = [(p, _sorted_packed(grams[x])) for p, x in enumerate(_by_part(grams, parts)) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int64()), pa.array([chunk] * len(own), pa.int64()), pa.array([x for _, x in own], pa.binary())], ["part", "chunk", "wanted"])

    def look_up(batches):
        for batch in batches:
            for k in range(len(batch)):
                part, asked, raw, raw_counts = (batch.column(c).slice(k, 1).to_pylist()[0] for c in ("part", "asked", "grams", "counts"))
                grams, counts = _sorted_unpacked(raw), _unpacked(raw_counts).reshape(2, -1)
                out = []
                for x in asked:
                    own = _sorted_unpacked(x["wanted"])
                    place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                    out.append(_packed(np.where(grams[place] == own, counts[:, place], 0).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([x["chunk"] for x in asked], pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array(out, pa.binary())], ["chunk", "part", "counts"])

    def judge(batches):
        unigram, history = tables.value
        for batch in batches:
            for k in range(len(batch)):
                ids, sizes = (_unpacked(batch.column(c).slice(k, 1).to_pylist()[0]) for c in ("ids", "sizes"))
                grams = distinct(ids)
                counts, places = np.zeros((2, len(grams)), np.int64), _by_part(grams, parts)
                for x in batch.column("found").slice(k, 1).to_pylist()[0] or []:
                    counts[:, places[x["part"]]] = _unpacked(x["counts"]).reshape(2, -1)
                n, starts = sizes - 1, np.cumsum(sizes) - sizes
                background, target = (np.add.reduceat(x, starts) / np.maximum(n, 1) for x in losses(ids, grams, counts, unigram, history))
                keys = batch.column("doc_ids").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, (n, target, background, target - background))], ["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    texts = stored(docs.select("doc_id", "text").mapInArrow(encode, f"chunk long, doc_ids array<{kind}>, sizes binary, ids binary"), "chunks")
    asked = texts.select("chunk", "ids").mapInArrow(wanted, "part long, chunk long, wanted binary").groupBy("part").agg(F.collect_list(F.struct("chunk", "wanted")).alias("asked"))
    found = asked.join(scorer.bigrams, "part").mapInArrow(look_up, "chunk long, part long, counts binary")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts")).alias("found"))
    return texts.join(found, "chunk", "left").mapInArrow(judge, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id of documents that are labelled good and not toxic, each once."""
    return stored(labels.where("quality = 1 and toxic = 0").select("doc_id").distinct(), "good")

"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit, a binary classifier tells the
languages that have it from those that don't, by letter n-grams: a linear score, the
mean over a text's n-grams of smoothed log odds. Up to seven languages get the
exhaustive code (every split of the languages once); more get random codewords, the
set with the largest least distance of ``TRIES``.

Decoding is loss-weighted: a language's loss is the sum over bits of the bit's weight
times log(1 + exp(-m s)), with s the scaled score and m = +1 or -1 the bit. The
smallest loss wins. The score is the softmax of the negative losses; a text whose two
smallest losses are close is flagged as ambiguous.

N-grams are of four letters after mapping to lower case, other characters to one
space, in the whole text, hashed to ``FEATURES`` numbers.

The classifiers are fitted on a sample of at most about ``SAMPLE`` distinct labelled
texts per language, chosen by a hash of the text: the documented bound. A text counts
once, however many copies it has. What is gathered is the counts of n-grams by language,
at most FEATURES x languages numbers; languages are few, as names of them are, and the
driver holds one row for each.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import ids_type, slices

FEATURES = 1 << 17
GRAM = 4
SAMPLE = 2000
SMOOTH = 0.5
TRIES = 200
UNKNOWN = "und"
#: Losses closer than this are ambiguous.
CLOSE = 0.05
_OTHER = re.compile(r"[\W\d_]+")


#: Characters of a text that are mapped to n-grams at once, so that memory doesn't grow with it.
PIECE = 1 << 20


def clean(text: str) -> str:
    """Lower case, other characters than letters as one space; empty without a letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return out if any(map(str.isalpha, out)) else ""


def grams(cleaned: str) -> np.ndarray:
    """Numbers of the n-grams of a cleaned text, in order."""
    codes = np.frombuffer(cleaned.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(codes) < GRAM:
        codes = np.concatenate([codes, np.full(GRAM - len(codes), 32, np.uint64)])
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = (h ^ codes[k : len(codes) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(FEATURES)).astype(np.int64)


def features(text: str):
    """Numbers of a text's n-grams, in order, in arrays of at most PIECE; a text without letters has none."""
    own = clean(text)
    if own:
        own = f" {own} "
        for a in range(0, max(1, len(own) - GRAM + 1), PIECE):
            yield grams(own[a : a + PIECE + GRAM - 1])


def codewords(n: int) -> np.ndarray:
    """n codewords of bits, as rows of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=n - 1) if -1 in s]
        return np.array([[1, *s] for s in splits]).T
    rng, best, far = np.random.default_rng(7), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(TRIES):
        code = rng.choice([1, -1], size=(n, width))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min((int((a != b).sum()) for a, b in itertools.combinations(code, 2)), default=0)
        if least > far:
            best, far = code, least
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bit_weight: np.ndarray
    scale: np.ndarray

    def scores(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(self.weights.shape[1]), 0
        for found in features(text):
            n += len(found)
            for a in range(0, len(found), 1 << 16):
                total += self.weights[found[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total / n if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is ambiguous."""
        s = self.scores(text) if text else None
        if s is None or not self.langs:
            return UNKNOWN, 0.0, False
        loss = (self.bit_weight * np.logaddexp(0, -self.code * (s * self.scale))).sum(axis=1)
        p = np.exp(loss.min() - loss)
        order = np.argsort(loss, kind="stable")
        close = len(loss) > 1 and loss[order[1]] - loss[order[0]] < CLOSE
        return self.langs[order[0]], float(p[order[0]] / p.sum()), bool(close)


def fit_counts(langs: list[str], counts: np.ndarray) -> Model:
    """A model from n-gram counts (languages x features)."""
    code = codewords(len(langs))
    rate = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True) if len(langs) else counts
    bits = code.shape[1] if len(langs) else 0
    weights = np.zeros((FEATURES, bits), np.float32)
    centre = np.zeros(bits)
    scale, worth = np.ones(bits), np.ones(bits)
    for b in range(bits):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            w = np.log(rate[yes].mean(axis=0)) - np.log(rate[no].mean(axis=0))
            means = rate @ w  # the mean score of each language's own n-grams
            low, high = means[yes].min(), means[no].max()
            centre[b] = (low + high) / 2
            weights[:, b] = w - centre[b]
            gap = max(low - high, 1e-6)
            scale[b] = 4 / gap  # a typical text of the nearest language scores 2
            worth[b] = gap
    worth = worth / worth.sum() * bits if bits else worth
    return Model(list(langs), code, weights, worth, scale)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0


def fit(training: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on (text, lang); null lang or text is left out. About ``sample`` distinct texts a language are learned from, by content hash."""
    labelled = training.select("text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.select("lang", F.xxhash64("text")).distinct().groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return fit_counts([], np.zeros((0, FEATURES)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))])
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(place < share[F.col("lang")]).distinct()

    def count(batches):
        total = np.zeros((len(langs), FEATURES), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    for found in features(text):
                        total[langs.index(lang)] += np.bincount(found, minlength=FEATURES)
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["lang", "gram", "n"])

    rows = chosen.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), FEATURES))
    counts[np.asarray(rows.column("lang")), np.asarray(rows.column("gram"))] = np.asarray(rows.column("n"))
    return fit_counts(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of every row, from its text alone.

    Null texts and texts without a letter are ``und`` with score 0. The model is sent
    with the tasks; its size is FEATURES x bits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = [own.predict(x) for x in part.column("text").to_pylist()]
                lang, score, close = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids_type(docs)}, lang_pred string, score double, ambiguous boolean")


def known_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is known and not ambiguous.

    A model of no languages, from a table without labels, can't tell: then all texts with
    a letter stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                if own.langs:
                    kept = [lang != UNKNOWN and not close for lang, _, close in map(own.predict, texts)]
                else:
                    kept = [any(map(str.isalpha, x or "")) for x in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

import math
import random
from collections import Counter

import pytest

from strandframe.llm import lm_score


def plain(docs, good, size):
    """Scores with the words of the highest counts, ties by the word, and exact bigrams."""
    tok = {i: t.encode().lower().split() for i, t in docs.items()}
    counts = Counter(w for x in tok.values() for w in x)
    of = {w: k + 2 for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[: size - 2])}
    ids = {i: [1, *[of.get(w, 0) for w in x]] for i, x in tok.items()}
    out = {i: [] for i in docs}
    for own in (good, set(docs)):
        uni, hist, bi = Counter(), Counter(), Counter()
        for i in own:
            uni.update(ids[i][1:])
            hist.update(ids[i][:-1])
            bi.update(zip(ids[i], ids[i][1:], strict=False))
        total = sum(uni.values()) + len(of) + 1
        for i, x in ids.items():
            each = [-math.log(bi[a, b] / (hist[a] + 8) + 8 / (hist[a] + 8) * (uni[b] + 1) / total) for a, b in zip(x, x[1:], strict=False)]
            out[i].append(sum(each) / len(each))
    return out


def check(spark, docs, size, slots):
    good = {i for i in docs if i % 3 == 0}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    scorer = lm_score.fit(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), size=size, slots=slots)
    got = {r.doc_id: r for r in lm_score.score(df, scorer).collect()}
    want = plain(docs, good, size)
    assert set(got) == set(want)
    for i, (target, background) in want.items():
        assert got[i].loss_target == pytest.approx(target, abs=1e-9) and got[i].loss_background == pytest.approx(background, abs=1e-9)
        assert min(got[i].loss_target, got[i].loss_background) >= 0


@pytest.mark.parametrize("chunk", [50, 1 << 19])
def test_more_bigrams_than_places(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm_score, "CHUNK", chunk)
    monkeypatch.setattr(lm_score, "PART_BYTES", 20 * chunk)
    rng = random.Random(3)
    check(spark, {i: " ".join(f"w{rng.randint(0, 40)}" for _ in range(40)) for i in range(40)}, size=64, slots=16)


@pytest.mark.parametrize("size", [2, 5, 12, 30])
def test_vocabulary_is_cut_within_a_class_of_counts(spark, size):
    """Words of about the same counts: a class of counts holds more than there is room for."""
    rng = random.Random(4)
    docs = {i: " ".join(f"w{rng.randint(0, 40)}" for _ in range(40)) for i in range(40)}
    counts = Counter(w for t in docs.values() for w in t.encode().split())
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert lm_score.vocabulary(df, size) == sorted(sorted(counts, key=lambda w: (-counts[w], w))[: size - 2])
    check(spark, docs, size, 1 << 20)


def test_vocabulary_of_equal_counts(spark):
    df = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(10, 60)))], "doc_id long, text string")
    assert lm_score.vocabulary(df, 12) == [f"w{i}".encode() for i in range(10, 20)]

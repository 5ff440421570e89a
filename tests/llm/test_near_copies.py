import random

from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import near_copies


def shingle_set(text):
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def kept_plainly(docs):
    """The smallest id of each component of Jaccard similarity 0.8, over all pairs."""
    ids, sets = sorted(docs), {i: shingle_set(t) for i, t in docs.items()}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if j < i and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in ids if root(i) == i}


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs = {}
    for base in range(30):
        words = [word() for _ in range(200)]
        docs[len(docs)] = " ".join(words)
        for changes in (1, 2, 3, 4, 5, 8, 15):  # 4 changed words: about 0.82; 5: about 0.78
            other = list(words)
            for at in rng.sample(range(0, 200, 7), changes):
                other[at] = word()
            docs[len(docs)] = " ".join(other)
    docs[len(docs)] = docs[0].upper()
    return docs


def test_the_stage_drops_all_near_copies_and_no_others(spark):
    docs = planted()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == kept_plainly(docs)


def test_crowded_keys_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MOST", 3)
    docs = planted()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.representatives(df).collect()} == kept_plainly(docs)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (4, "c d"), (5, "A  b"), (None, "a b"), (6, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str(r.doc_id) for r in near_copies.representatives(df).collect())
    assert got == ["1", "4", "6", "None"]
    assert near_copies.representatives(df.where(F.lit(False))).count() == 0

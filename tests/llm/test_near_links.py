"""Links of a large group of near copies: few of them, and with the components of all."""

import random

import numpy as np

from strandframe.llm import near_copies as nc
from tests.llm.test_near_copies import kept_plainly, planted


def test_a_group_is_linked_by_one_row_a_member():
    for size in (nc.FEW, 500):
        visits = np.zeros(2 * size, nc._VISIT)  # each key visits two anchors
        visits["key"] = np.tile(np.random.default_rng(size).permutation(size) - 5, 2)
        visits["anchor"] = np.repeat([3, 8], size)
        assert nc.links(visits).tolist() == [[-5, k] for k in range(-4, size - 5)]
        visits["key"] = 7  # joined before, as one node
        assert nc.links(visits).shape == (0, 2)


def test_thinned_links_are_stars():
    links = np.array([[9, 4], [4, 30], [30, 9], [1, 2], [2, 1], [50, 50], [8, 30]])
    assert sorted(nc.thinned(links).tolist()) == [[1, 2], [4, 8], [4, 9], [4, 30]]
    assert nc.thinned(np.zeros((0, 2), np.int64)).shape == (0, 2)
    rng = np.random.default_rng(6)
    chain = np.stack([order := rng.permutation(3000), np.roll(order, 1)], axis=1)[1:]
    assert sorted(nc.thinned(chain).tolist()) == [[0, k] for k in range(1, 3000)]


def with_a_large_group():
    docs, rng = planted(), random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for _ in range(150):
        other = list(words)
        other[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs[len(docs)] = " ".join(other)
    return docs


def test_a_large_group_gives_few_links_to_the_components(spark, monkeypatch):
    docs, given = with_a_large_group(), []
    whole = nc.components

    def counted(links):
        given.append(links.count())
        return whole(links)

    monkeypatch.setattr(nc, "components", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in nc.representatives(df).collect()} == kept_plainly(docs)
    assert 150 < max(given) < len(docs)


def test_links_of_any_block_and_of_several_tasks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(nc, "FIRST", 1)
    monkeypatch.setattr(nc, "LINKS", 40)
    docs = with_a_large_group()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in nc.representatives(df).collect()} == kept_plainly(docs)

import random

import numpy as np
import pytest

from strandframe.llm import simhash, suffix_dedup
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key int, key string, spans string, fp int, n int, label string"


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", len(t or ""), 1, "k", "s", 0, 0, "l") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def repeats(rng):
    """Texts with shared passages around the limit, near copies, copies, runs of one letter, and short ones."""
    passage = words(rng, 400)
    raw = passage.encode()
    texts = [None, "", "a" * 399, "b" * 400, "c" * 401, "x" * 3000, words(rng, 300), passage]
    for size in (398, 399, 400, 401, 410, 450, 600, 799, 1200):
        for _ in range(2):
            at = rng.randint(0, len(raw) - size)
            texts.append(words(rng, rng.randint(0, 90)) + raw[at : at + size].decode(errors="ignore") + words(rng, rng.randint(0, 90)))
    for _ in range(6):  # near copies
        w = passage.split(" ")
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))
    copy = words(rng, 200)
    return [*texts, copy, copy, copy, "ab" * 600, words(rng, 100) + "ab" * 300]


@pytest.mark.parametrize("seed", range(3))
def test_removed_bytes_equal_brute_force(spark, seed):
    texts = repeats(random.Random(seed))
    got = suffix_dedup.dedup_digests(frame(spark, texts)).orderBy("doc_id").collect()
    want = brute.removed(texts)
    assert [tuple(r)[1:] for r in got] == want


@pytest.mark.parametrize("length", [60, 240])
def test_other_lengths(spark, length):
    texts = repeats(random.Random(length))
    got = suffix_dedup.dedup_digests(frame(spark, texts), length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.removed(texts, length)


@pytest.mark.parametrize(("length", "passage"), [(400, 240), (120, 60), (100, 100)])
def test_shorter_passages_are_reported(spark, length, passage):
    texts = repeats(random.Random(length))
    got = suffix_dedup.dedup_digests(frame(spark, texts), length, passage).orderBy("doc_id").collect()
    assert [tuple(r)[1:5] for r in got] == brute.removed(texts, length)
    assert [r.n_passage_bytes for r in got] == [x[1] for x in brute.removed(texts, passage)]


def test_passages_longer_than_what_is_removed(spark):
    for passage in (500, 20):
        with pytest.raises(ValueError):
            suffix_dedup.dedup_digests(frame(spark, ["a"]), 400, passage)


def test_removed_bytes_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    got = suffix_dedup.dedup_digests(docs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.removed(texts)


def test_repeated_rows_and_null_ids(spark):
    text = words(random.Random(9), 120)
    docs = frame(spark, [text, text, "z", words(random.Random(8), 120)], [None, None, 5, None])
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_digests(docs).collect()}
    n = len(text.encode())
    assert (None, n, n) in got and (5, 1, 0) in got and len(got) == 3


def test_empty_table(spark):
    docs = frame(spark, ["a"]).where("false")
    assert suffix_dedup.dedup_digests(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.representatives(docs).count() == 0


def test_remove_repeats_keeps_rows_columns_and_characters(spark):
    texts = repeats(random.Random(4))
    docs = frame(spark, texts)
    out = suffix_dedup.remove_repeats(docs)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts) and rows[0].text is None
    want = brute.removed(texts)
    for i, t in enumerate(texts):
        if t is not None:
            assert len(rows[i].text.encode()) <= want[i][0] - want[i][1]
            assert want[i][1] or rows[i].text == t
            assert rows[i].n_chars == len(rows[i].text)


def test_merge_of_runs_gives_sorted_order_and_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        runs = [[bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 9))]
        blobs = [suffix_dedup.write_run([(x, bytes([rng.randrange(3)]), b"\0" * 24) for x in r])[0] for r in runs]
        merged = list(suffix_dedup.merge_runs([suffix_dedup.read_run(b) for b in blobs]))
        firsts = [m[1] for m in merged]
        assert firsts == sorted(firsts) and set(firsts) == {x for r in runs for x in r}
        for a, b in zip(merged, merged[1:], strict=False):
            assert b[0] == suffix_dedup.common(a[1], b[1])


def test_a_run_reports_what_it_repeats():
    own = [bytes([k]) * 24 for k in range(4)]
    blob, known = suffix_dedup.write_run([(b"a", b"x", own[0]), (b"b", b"x", own[1]), (b"a", b"x", own[2]), (b"a", b"y", own[3])])
    assert known == [own[0], own[2]]
    assert [(e[1], e[2], e[3]) for e in suffix_dedup.read_run(blob)] == [(b"a", b"x", own[0] * 2), (b"a", b"y", own[3]), (b"b", b"x", own[1])]


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_run_sizes_do_not_matter(spark, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", size)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
    texts = repeats(random.Random(7)) + [words(random.Random(5), 90) * 2] + ["line of text that is common " * 60] * 2 + ["line of text that is common " * 50 + "!"]
    got = suffix_dedup.dedup_digests(frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.removed(texts)


@pytest.mark.parametrize(("hot", "length"), [(1, 400), (1, 60), (3, 400), (5, 240)])
def test_crowded_cores_are_cut_finer(spark, monkeypatch, hot, length):
    """A passage with many surroundings: longer and shorter than a window, at the ends of texts, repeated within one."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot + length)
    texts = repeats(rng)
    passage = words(rng, 120)
    for size in (length // 2 + 20, length - 1, length, length + 1, length + 30, 2 * length):
        texts += [words(rng, rng.randint(0, 60)) + passage[:size] + words(rng, rng.randint(0, 60)) for _ in range(4)]
    texts += [passage, passage + passage, passage[7:], "x" + passage[7:]]
    got = suffix_dedup.dedup_digests(frame(spark, texts), length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute.removed(texts, length)


def test_anchors_tile_the_windows_and_depend_on_the_window_alone():
    raw = np.frombuffer(words(random.Random(1), 600).encode(), np.uint8)
    pos, lo, hi = suffix_dedup.window_anchors(raw)
    starts = np.concatenate([np.arange(p - b, p - a + 1) for p, a, b in zip(pos, lo, hi, strict=True)])
    assert starts.tolist() == list(range(len(raw) - 399))
    for p, a, b in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True):
        alone = suffix_dedup.window_anchors(raw[p - b : p - b + 400])
        assert alone[0][0] == b
        assert suffix_dedup.window_anchors(raw[p - a : p - a + 400])[0][0] == a


def near_prints(rng, n):
    centre = [rng.getrandbits(64) for _ in range(4)]
    out = []
    for _ in range(n):
        x = rng.choice(centre)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("most", [256, 20, 3])
def test_components_of_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(5)
    prints = near_prints(rng, 300)
    distinct = sorted(set(prints))
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in distinct]
    found = simhash.components(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()
    label = {r.node % (1 << 64): r.label for r in found}
    want = brute.component_ids(list(range(len(distinct))), distinct)
    groups = {}
    for i, x in enumerate(distinct):
        groups.setdefault(want[i], set()).add(label.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    rows = [(order[i], order[i + 1]) for i in range(199)]
    found = simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()
    assert {r.label for r in found} == {0} and len(found) == 200


def test_every_anchor_pair_meets():
    rng = random.Random(6)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for _ in range(rng.randint(0, 2)):
            y ^= 1 << rng.randrange(64)
        at = [set(simhash.anchors(np.array([v], np.uint64).view(np.int64))[0].tolist()) for v in (x, y)]
        assert at[0] & at[1] and max(map(len, at)) <= 17


def test_members_of_an_anchor_that_link_share_a_second_one():
    rng = random.Random(7)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for _ in range(rng.randint(0, 2)):
            y ^= 1 << rng.randrange(64)
        pair = []
        for v in (x, y):
            at, own = simhash.anchors(np.array([v], np.uint64).view(np.int64))
            second, place = simhash.second_anchors(at, own)
            assert np.bincount(place).max() <= 9
            pair.append(set(zip(at[place].tolist(), second.tolist(), strict=True)))
        assert pair[0] & pair[1]


def test_crowded_anchors(spark):
    """Several hundred classes around few centres, so that anchors hold more than MOST of them."""
    rng = random.Random(8)
    distinct = set()
    while len(distinct) < 900:
        x = 0x0123456789ABCDEF
        for at in rng.sample(range(31, 64) if len(distinct) < 500 else range(31), rng.randint(1, 4)):
            x ^= 1 << at
        distinct.add(x)
    distinct = sorted(distinct)
    frame_of = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in distinct], "fp long")
    label = {r.node % (1 << 64): r.label for r in simhash.components(simhash.links(frame_of)).collect()}
    want = brute.component_ids(list(range(len(distinct))), distinct)
    groups = {}
    for i, x in enumerate(distinct):
        groups.setdefault(want[i], set()).add(label.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert simhash._visits(frame_of).groupBy("anchor").count().agg({"count": "max"}).first()[0] > simhash.MOST


def test_representatives_with_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", "p"), (2, "a b c d", "q"), (3, "x y z", "r")], "doc_id long, text string, `x.y` string")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_simhash_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = frame(spark, [None, "", "One", "one two", " \t\n", "ONE\x0btwo"], [900, 901, 902, 903, 904, 905]).select("doc_id", "text")
    both = docs.select("doc_id", "text").union(extra)
    rows = both.orderBy("doc_id").collect()
    prints = [brute.fingerprint(r.text) for r in rows]
    want = brute.component_ids([r.doc_id for r in rows], prints)
    got = simhash.near_duplicates(both).orderBy("doc_id").collect()
    assert [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in got] == list(zip([r.doc_id for r in rows], prints, want, strict=True))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for r, c in zip(rows, want, strict=True) if r.doc_id < 900})


@pytest.mark.parametrize("small", [64 << 20, -1])
def test_representatives_of_repeated_rows(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BYTES", small)
    docs = frame(spark, ["a b c d", "a b c d", "a b c d", "q r s t"], [1, 1, 2, 3])
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [1, 3]
    docs = frame(spark, ["a b c d", "a b c d", "q r s t", "q r s t"], [None, 2, 5, None])
    assert sorted((r.doc_id or 0) for r in simhash.representatives(docs).collect()) == [0, 0, 2, 5]

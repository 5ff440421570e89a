import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandframe.llm import bpe_automaton, packing, token_planes, tokens
from strandframe.llm.common import scratch_path

ODD_IDS = {"date": "date_add(date'2020-01-01', CAST(id AS int))", "timestamp": "timestamp_seconds(id)", "binary": "CAST(id AS string)"}
BYTES, WORDS = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\n\n", " \n", "a", "the", "'s", "é", "日本", "1", "23", "!", "\t", "\xa0", "\x1c", "<|endoftext|>", "aaaa", "ing", "tion", "\u0301", "🙂", "\r\n", "'", "Ω", "_", "\x85", "İ", "ß,", "Word.", " x|"]
AWKWARD = [None, "", " ", "a" * 5000, "ab " * 3000, "<|startoftext|> x<|endoftext|>", "e\u0301 É"]


def lib(path):
    return Tokenizer.from_file(path)


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", 1, "y", 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int, part string, shard int").repartition(3)


def table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_encoders_equal_the_library(parts):
    text = "".join(parts)
    for path, coder in ((BYTES, tokens.encoder(BYTES, "bytes")), (BYTES, bpe_automaton.automaton_encoder(BYTES)), (WORDS, tokens.encoder(WORDS, "words"))):
        want = _LIB[path].encode(text, add_special_tokens=False).ids
        got = np.frombuffer(coder.encode([text])[0], "<u4")
        assert got.tolist() == want
        if isinstance(coder, bpe_automaton.AutomatonEncoder):
            assert coder.decode(got) == _LIB[path].decode(want, skip_special_tokens=False)


_LIB = {p: lib(p) for p in (BYTES, WORDS)}


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_KEPT", 20)
    coder = tokens.PieceEncoder(BYTES)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice(["alpha", "Beta,", "gamma.", "été", "x" * 60, "1", "q\nr", "delta!!"]) + str(rng.randint(0, 9)) * rng.randint(0, 1) for _ in range(12)) for _ in range(4)]
        want = [e.ids for e in _LIB[BYTES].encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want
        assert len(coder.kept) + len(coder.older) < 120


def test_automaton_of_small_merge_lists():
    """Against merging by hand, with repeated letters and merges that block each other."""
    rng = random.Random(3)
    letters = tokens.byte_letters()
    for _ in range(80):
        vocab = {c: k for k, c in enumerate(letters)}
        merges, have = [], ["a", "b", "c"]
        for _ in range(rng.randint(1, 14)):
            u, v = rng.choice(have), rng.choice(have)
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                have.append(u + v)
        made = bpe_automaton.MergeAutomaton(vocab, merges)
        for _ in range(60):
            word = "".join(rng.choice("abc" if rng.random() < 0.7 else "a") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if (parts[i], parts[i + 1]) == (u, v):
                        parts[i : i + 2] = [u + v]
                    i += 1
            if word not in vocab or parts == [word]:
                assert made.word(word) == [vocab[p] for p in parts]


def test_round_trip_digests(spark):
    docs = table(spark)
    texts = [*docs.values(), *AWKWARD]
    got = {r.doc_id: r for r in bpe_automaton.round_trip_digests(frame(spark, texts), BYTES).collect()}
    for i, t in enumerate(texts):
        ids = _LIB[BYTES].encode(t or "", add_special_tokens=False).ids
        back = _LIB[BYTES].decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_encode_and_decode_frames(spark):
    df = frame(spark, AWKWARD)
    back = bpe_automaton.decode(bpe_automaton.encode(df, BYTES), BYTES).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(AWKWARD)}


@pytest.mark.parametrize("bits", [1, 8])
def test_plane_files_keep_ids(bits):
    rng = np.random.default_rng(5)
    docs = [(k, rng.integers(0, 1 << rng.integers(1, 32), rng.integers(0, 700)).astype("<u4")) for k in range(50)] + [(None, np.zeros(0, "<u4"))]
    raw = token_planes.dumps(docs, bits, 256)

    class Source(io.BytesIO):
        def size(self):
            return len(raw)

    reader = token_planes.PlaneReader(Source(raw))
    back = list(reader)
    assert [k for k, _ in back] == [k for k, _ in docs]
    assert all((a == b).all() and len(a) == len(b) for (_, a), (_, b) in zip(back, docs, strict=True))
    assert len(token_planes.dumps([], bits)) > 0
    for broken in (raw[:-1], b"", raw[:20]):
        with pytest.raises(ValueError):
            token_planes.PlaneReader(pa.BufferReader(broken))


def test_written_ids(spark):
    docs = table(spark)
    texts = [*AWKWARD, *docs.values()]
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    got = token_planes.write_and_read(frame(spark, texts, ids), WORDS, scratch_path(spark, "planes")).collect()
    start = 0
    have = {r.doc_id: r for r in got}
    assert len(have) == len(texts)
    for key, text in sorted(zip(ids, texts, strict=True)):
        want = [*_LIB[WORDS].encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(have[key])[1:] == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


@pytest.mark.parametrize("kind", ["int", "date", "decimal(12,2)", "string", "timestamp", "binary", "double"])
def test_ids_of_any_type_come_back(spark, tmp_path, kind):
    docs = spark.sql(f"SELECT CAST({ODD_IDS.get(kind, 'id')} AS {kind}) AS doc_id, CAST(id AS string) AS text FROM range(3) UNION ALL SELECT NULL, NULL")
    got = token_planes.write_and_read(docs, WORDS, str(tmp_path / "planes"))
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, (r.doc_id for r in docs.collect())))


def test_written_empty_table_and_repeated_rows(spark):
    assert token_planes.write_and_read(frame(spark, ["a"]).where("false"), WORDS, scratch_path(spark, "planes")).count() == 0
    got = token_planes.write_and_read(frame(spark, ["a", "a", "b"], [1, 1, None]), WORDS, scratch_path(spark, "planes")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 2), (1, 4, 2)]


def check_packing(rows, ids_of, most=1024):
    """All ids once and in order, gapless sequences; returns the share of padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for key, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids_of[key])
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[key][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids_of[key])
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= most
        total += at
        pad += 0 if at & (at - 1) == 0 else most - at
    return pad / (pad + total)


@pytest.mark.parametrize("segment", [1 << 20, 3000])
def test_packing(spark, monkeypatch, segment):
    monkeypatch.setattr(packing, "SEGMENT", segment)
    texts = [*table(spark).values(), *AWKWARD]
    rows = packing.pack(frame(spark, texts), BYTES).collect()
    ids_of = {i: [*_LIB[BYTES].encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert check_packing(rows, ids_of) < 0.02


def test_packing_of_no_rows(spark):
    assert packing.pack(frame(spark, ["a"]).where("false"), BYTES).count() == 0


def test_cuts_are_the_cheapest():
    """The monotone queue against trying every start."""
    rng = random.Random(8)
    for _ in range(200):
        most = rng.choice([8, 16, 20, 70])
        at = sorted(rng.sample(range(1, 80), rng.randint(1, 30)))
        known = [0]
        for a in at:  # gaps that no window can span are filled
            while a - known[-1] > most:
                known.append(known[-1] + most)
            known.append(a)
        points, penalty = known[1:], [rng.choice([0, 2, 16]) for _ in known[1:]]

        def pad(n, most=most):
            return 0 if n & (n - 1) == 0 else most - n

        def cost(cuts, points=points, penalty=penalty):
            ends = dict(zip(points, penalty, strict=True))
            return sum(pad(b - a) + packing.SEQUENCE_COST + ends[b] for a, b in zip([0, *cuts], cuts, strict=False))

        def known_pad(n, most=most):  # powers below most / 4 aren't tried
            return pad(n) if n >= most >> 2 else most - n

        best = {0: 0}
        for b, p in zip(points, penalty, strict=True):
            best[b] = min(best[a] + known_pad(b - a) + packing.SEQUENCE_COST + p for a in best if b - a <= most)
        cuts = packing.best_cuts(points, penalty, most)
        assert cuts[-1] == points[-1] and all(b - a <= most for a, b in zip([0, *cuts], cuts, strict=False))
        assert cost(cuts) <= best[points[-1]]


def test_cuts_within_sentences():
    """Only sentences that are longer than a sequence are cut, whatever the lengths."""
    closes = np.array([False, True, False])  # ids: a word, a word that ends a sentence, the end of a document
    for gaps in ([3, 64, 65, 200, 1024], [1024, 1024], [1025], [5000, 1, 1023], [10]):
        ids = np.concatenate([[0] * (g - 1) + [1] for g in gaps] + [[2]])
        at, penalty = packing.cut_points(ids, np.array([len(ids)]), closes, 1024)
        ends = np.cumsum(gaps).tolist()
        assert set(ends) <= set(at.tolist()) and at[-1] == len(ids) and np.diff(at, prepend=0).max() <= 1024
        for p, cost in zip(at.tolist(), penalty.tolist(), strict=True):
            inside = p not in ends and p != len(ids)
            assert inside == (cost == packing.LONG_CUT)
            assert not inside or gaps[np.searchsorted(ends, p)] > 1024


def test_short_sequences_without_padding():
    """A sequence of 64 tokens is made where it saves padding, one of 32 isn't tried."""
    assert packing.best_cuts([64, 100], [0, 0], 1024) == [100]
    assert packing.best_cuts([64, 1024 + 64], [0, 0], 1024) == [64, 1088]
    assert packing.best_cuts([32, 64], [0, 0], 1024) == [64]

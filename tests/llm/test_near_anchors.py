"""The near-duplicate stage finds its pairs by SimHash and anchors of covering codes."""

import itertools

import numpy as np

from strandframe.llm import near_copies as nc

MASK = (1 << 64) - 1


def plain_bits(own):
    ones = [0] * nc.BITS
    for h in own.tolist():
        for w, drawn in enumerate(nc._DRAWN.tolist()):
            x = h ^ drawn
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
            x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
            x ^= x >> 31
            for k in range(64):
                ones[64 * w + k] += x >> k & 1
    return [2 * n > len(own) for n in ones]


def codewords(width):
    """The words whose numbers, from 1, of set bits have an exclusive or of 0."""
    out = []
    for word in range(1 << width):
        s = 0
        for k in range(width):
            s ^= (k + 1) * (word >> k & 1)
        if not s:
            out.append(word)
    return out


def pairs_near(similarity, n, trials, rng):
    both = round(2 * n * similarity / (1 + similarity))
    for _ in range(trials):
        drawn = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        yield np.sort(drawn[:n]), np.sort(drawn[n - both :])


def test_fingerprints_are_majorities_and_anchors_the_codewords_within_1():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 4, 300)]
    prints = np.array([nc.fingerprint(x) for x in sets])
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
    assert bits.astype(bool).tolist() == [plain_bits(x) for x in sets]
    codes = {width: codewords(width) for width in nc.CODES}
    found = nc.anchors(prints)
    for row, own in zip(found.tolist(), bits, strict=True):
        for anchor, places in zip(row, nc._PLACES, strict=True):
            at = 0
            for width in nc.CODES:
                word = sum(int(own[p]) << k for k, p in enumerate(places[at : at + width]))
                assert [c for c in codes[width] if (c ^ word).bit_count() <= 1] == [anchor >> at & (1 << width) - 1]
                at += width


def test_links_have_the_components_of_all_pairs(monkeypatch):
    monkeypatch.setattr(nc, "FEW", 5)
    rng = np.random.default_rng(4)
    visits = np.zeros(120, nc._VISIT)
    visits["key"] = rng.permutation(120) - 60
    visits["anchor"] = np.where(np.arange(120) < 60, 7, rng.integers(8, 30, 120))
    base = rng.integers(0, 1 << 63, (6, nc.CHECKED), dtype=np.uint64)
    visits["fp"] = base[rng.integers(0, 6, 120)]
    for _ in range(34):  # so that pairs differ in up to 68 bits, around RADIUS
        k = rng.integers(0, 64 * nc.CHECKED, 120)
        visits["fp"][np.arange(120), k // 64] ^= np.uint64(1) << (k % 64).astype(np.uint64)

    def components(pairs):
        of = {k: {k} for k in visits["key"].tolist()}
        for a, b in pairs:
            if of[a] is not of[b]:
                both = of[a] | of[b]
                of |= dict.fromkeys(both, both)
        return {frozenset(x) for x in of.values()}

    plain = [(int(x["key"]), int(y["key"])) for x, y in itertools.combinations(visits, 2) if x["anchor"] == y["anchor"] and int(np.bitwise_count(x["fp"] ^ y["fp"]).sum()) <= nc.RADIUS]
    assert len(plain) > 100 and 10 < len(components(plain)) < 110
    assert components(nc.links(visits).tolist()) == components(plain)


def test_pairs_of_similarity_0_8_meet_and_others_hardly_do():
    for similarity, n, least, most in ((0.8, 200, 0.998, 1), (0.2, 200, 0, 0.001)):
        prints = [np.array([nc.fingerprint(x[k]) for x in pairs_near(similarity, n, 1000, np.random.default_rng(5))]) for k in (0, 1)]
        meet = (nc.anchors(prints[0]) == nc.anchors(prints[1])).any(axis=1)
        link = np.bitwise_count(prints[0][:, : nc.CHECKED] ^ prints[1][:, : nc.CHECKED]).sum(axis=1) <= nc.RADIUS
        assert least <= (meet & link).mean() <= most

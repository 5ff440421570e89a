"""Plain, single-machine versions of the operators, to hold them against."""

import hashlib
import re
from collections import Counter

import xxhash


def removed(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(doc_ids, prints, threshold=2):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(doc_ids):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [least[root(i)] for i in range(len(prints))]

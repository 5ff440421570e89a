"""Byte-level BPE by a deterministic token automaton.

The merges are compiled one after the other. The automaton starts with one state
on which every byte loops. The gadget of a merge ``u v -> w`` redirects all arcs
labelled ``u`` to a copy of their target that lacks the ``v`` arc, and adds an arc
``w`` to every state from which ``u`` and then ``v`` could be read. In the end it
accepts exactly the correct tokenization of every word, and exactly one for each.

All arcs with one label lead to one state at any time, so a copy is stored as
(parent, removed label, merge number) and shares the arcs of its parent: an arc is
looked up along these links once and then kept in the transition table.

A word is read from left to right, by the longest arc that leads on. Every prefix has
one accepted tokenization only, so a position is reached in one state only, and is
given up for good once no arc leads on from it. Time is linear in the word's length,
whatever it holds. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandframe.llm import tokens
from strandframe.llm.common import ids_type, slices

MOST_ARCS = 2_000_000


class MergeAutomaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        n = max([*vocab.values(), *(special or {}).values()]) + 1
        self.vocab, self.special = dict(vocab), dict(special or {})
        self.born, self.left = [-1] * n, [-1] * n
        self.target = [0] * n
        self.parent, self.cut, self.made = [-1], [-1], [-1]
        self.arcs: dict[int, int] = {}
        self.size = n
        self.dead: set[int] = set()
        seen: set[int] = set()
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if w in seen:
                raise ValueError(f"two merges make the token {a + b!r}")
            seen.add(w)
            self._add(k, u, v, w)
        letters = tokens.byte_letters()
        byte_of = {c: bytes([b]) for b, c in enumerate(letters)}
        alphabet = set(byte_of)
        for token in [t for t, i in self.vocab.items() if i in self.dead or i not in seen and t not in alphabet]:
            del self.vocab[token]  # no merge makes it, so no text contains it
        self.labels: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.labels[i] = b"".join(byte_of.get(c, c.encode()) for c in token)
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        self.longest = max(map(len, self.vocab), default=1)
        self._index()
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _add(self, k: int, u: int, v: int, w: int) -> None:
        """The gadget of merge number k."""
        old = self.target[u]
        self.born[w], self.left[w] = k, u
        if u in self.dead or v in self.dead or not self.follows(old, v):
            self.dead.add(w)  # no text is ever merged to it
            return
        self.parent.append(old)
        self.cut.append(v)
        self.made.append(k)
        self.target[w] = old if u == v else self.target[v]
        self.target[u] = len(self.parent) - 1

    def follows(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label."""
        while state:
            if self.born[token] >= self.made[state]:  # added by a later gadget: where its first half could be read
                token = self.left[token]
            elif token == self.cut[state]:
                return False
            else:
                state = self.parent[state]
        return True

    def step(self, state: int, token: int) -> int:
        """The next state, or -1."""
        key = state * self.size + token
        to = self.arcs.get(key)
        if to is None:
            to = self.target[token] if self.follows(state, token) else -1
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            self.arcs[key] = to
        return to

    def _index(self) -> None:
        """A tree of the tokens' letters, with each token's id at None, and each token's longest shorter prefix token."""
        self.tree: dict = {}
        self.length, self.shorter = [0] * self.size, [-1] * self.size
        for token, i in self.vocab.items():
            node = self.tree
            for c in token:
                node = node.setdefault(c, {})
            node[None] = i
            self.length[i] = len(token)
        for token, i in self.vocab.items():
            node = self.tree
            for c in token[:-1]:
                node = node[c]
                self.shorter[i] = node.get(None, self.shorter[i])

    def word(self, letters: str) -> list[int]:
        """Ids of one pre-split word, in the vocabulary's letters."""
        whole = self.vocab.get(letters)
        if whole is not None:
            return [whole]
        n, step, length, shorter, tree = len(letters), self.step, self.length, self.shorter, self.tree
        arc, size = self.arcs.get, self.size
        dead, path, states = bytearray(n + 1), [], [0]
        at, fresh, token = 0, True, -1
        while at < n:
            if fresh:  # the longest token here
                node, token = tree, -1
                for c in letters[at : at + self.longest]:
                    if c not in node:
                        break
                    node = node[c]
                    if None in node:
                        token = node[None]
            if token < 0:  # no arc leads on: this position is left for good
                if not path:
                    raise ValueError(f"no token for {letters[at]!r}")
                dead[at] = 1
                states.pop()
                token = path.pop()
                at -= length[token]
            else:
                end = at + length[token]
                to = arc(states[-1] * size + token)
                if to is None:
                    to = step(states[-1], token)
                if to >= 0 and not dead[end]:
                    path.append(token)
                    states.append(to)
                    at, fresh = end, True
                    continue
            token, fresh = shorter[token], False
        return path


class AutomatonEncoder(tokens.PieceEncoder):
    """Encodes whole texts: the library's pre-tokenizer splits pieces into words, the automaton reads the words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        super().__init__(path)
        self.automaton = MergeAutomaton(model["vocab"], merges, {x["content"]: x["id"] for x in spec["added_tokens"]})

    def _word(self, letters: str) -> list[int]:
        return self.automaton.word(letters)

    def _others(self, pieces: list[str]) -> list[bytes]:
        a, split, out = self.automaton, self.library.pre_tokenizer.pre_tokenize_str, []
        for piece in pieces:
            ids: list[int] = []
            for part in a.splitter.split(piece) if a.splitter else (piece,):
                if part in a.special:
                    ids.append(a.special[part])
                elif part:
                    for word, _ in split(part):
                        ids += a.word(word)
            out.append(tokens.id_bytes(ids))
        return out

    def decode(self, ids: np.ndarray) -> str:
        labels = self.automaton.labels
        return b"".join(map(labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def automaton_encoder(path: str) -> AutomatonEncoder:
    return AutomatonEncoder(path)


def _blobs(docs: DataFrame, path: str, rows, schema: str) -> DataFrame:
    def run(batches):
        coder = automaton_encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                yield rows(part.column("doc_id"), coder, coder.encode(texts))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text; null and empty texts have none. Repeated rows stay."""

    def rows(keys, coder, blobs):
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in blobs]
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _blobs(docs, path, rows, f"doc_id {ids_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        coder = automaton_encoder(path)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.asarray(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids_type(encoded)}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: n_tokens, ids_sha256 and decoded_sha256, in one pass without a shuffle.

    Null texts count as empty; repeated rows stay; other columns are ignored.
    """

    def rows(keys, coder, blobs):
        back = [coder.decode(np.frombuffer(x, "<u4")) for x in blobs]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array([len(x) // 4 for x in blobs], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _blobs(docs, path, rows, f"doc_id {ids_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")

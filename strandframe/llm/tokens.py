"""Exact, cached encoding of whole texts with the tokenizers library.

A text is cut where the pre-tokenizer certainly starts a new word; equal pieces
are encoded once by the library and then looked up. A piece that is a plain Latin word
with or without punctuation behind it is two words of the pre-tokenizer; the library's
BPE model gets such a word directly. Pieces of more than ``LONGEST_KEPT`` ids aren't kept.
There are two generations of ``MOST_KEPT`` pieces at most: when the younger is full,
the older is dropped and takes its place, so memory is bounded.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import sys
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MOST_KEPT = 1_000_000
LONGEST_KEPT = 48

#: One space between two characters that aren't space: byte-level splitting starts a word at that space.
_SPACE = re.compile(r" (?<=\S )(?=\S)")
#: One line feed between two such characters is a word of its own.
_LINE = re.compile(r"(?<=\S)(\n)(?=\S)")
_LINE_FEED = ("\n",)

#: A word and the punctuation behind it; letters that lower case keeps whole.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*&$%#|]*)")
#: Bytes of texts that are encoded at once, so that their pieces stay near the processor.
AT_ONCE = 1 << 16


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the others from 256 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def default_path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def byte_pieces(text: str) -> list:
    """Pieces of a text for byte-level BPE, in order: strings follow a space, which they don't hold; 1-tuples hold all their text."""
    out: list = []
    flat = text.replace("\n", " ")
    if flat.isprintable() and "  " not in flat and flat[:1] != " " and flat[-1:] != " ":
        # no white space but single spaces and line feeds, each between two other characters
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            out += (_LINE_FEED, (first,)) if k else ((first,),)
            out += rest
        return out
    for line in _LINE.split(text) if "\n" in text else (text,):
        first, *rest = _SPACE.split(line)
        out.append((first,))
        out += rest
    return out


def word_pieces(text: str) -> list:
    """Pieces of a text for a vocabulary whose pre-tokenizer drops white space."""
    return text.replace("\n", " ").split(" ")


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    made = array("I", ids)
    if made.itemsize != 4 or sys.byteorder != "little":
        return struct.pack(f"<{len(ids)}I", *ids)
    return made.tobytes()


class PieceEncoder:
    """Encodes texts to the bytes of little-endian unsigned 32-bit ids.

    lower: whether the library's normalizer makes lower case and drops white space;
    then no piece follows a space.
    """

    def __init__(self, path: str, cut=byte_pieces, lower: bool = False):
        self.library, self.cut, self.lower = library(path), cut, lower
        self.kept, self.older = {}, {}
        self.letters = byte_letters()

    def forget(self) -> None:
        """Drops what is kept, which else stays as long as the Python worker."""
        self.kept, self.older = {}, {}

    def _words(self, words: list) -> list[bytes]:
        """Ids of pieces that are plain words."""
        read, letters, out = self._word, self.letters, []
        space = "" if self.lower else letters[32]
        for piece in words:
            before, word = ("", piece[0]) if type(piece) is tuple else (space, piece)
            if self.lower:
                word = word.lower()
            if not word.isascii():
                word = "".join([letters[b] for b in word.encode()])
            out.append(id_bytes(read(before + word)))
        return out

    def _word(self, letters: str) -> list[int]:
        """Ids of one word of the pre-tokenizer, in the vocabulary's letters."""
        return [t.id for t in self.library.model.tokenize(letters)]

    def _others(self, texts: list[str]) -> list[bytes]:
        """Ids of any texts."""
        return [id_bytes(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, piece) -> str:
        return piece[0] if type(piece) is tuple else piece if self.lower else " " + piece

    def _fill(self, missing: list) -> dict:
        """Ids of pieces that aren't kept, and of their parts."""
        kept, older, plain = self.kept.get, self.older.get, _PLAIN.fullmatch
        out, words, others, joined = {}, set(), [], []
        for piece, ids in zip(missing, map(older, missing), strict=True):
            if ids is not None:
                out[piece] = ids
                continue
            whole = type(piece) is tuple
            found = plain(piece[0] if whole else piece)
            if found is None:
                others.append(piece)
                continue
            word, rest = found.groups()
            if rest:
                joined.append((piece, (word,) if whole else word, (rest,)) if not self.lower else (piece, word, rest))
            else:
                words.add(piece)
        parts = {x for _, word, rest in joined for x in (word, rest)}
        parts.difference_update(out, words)
        known = {}
        for x in parts:
            ids = kept(x) or older(x)
            if ids is not None:
                known[x] = ids
            elif (x[0] if type(x) is tuple else x)[-1].isalpha():
                words.add(x)
            else:
                others.append(x)
        words = list(words)
        out.update(zip(words, self._words(words), strict=True))
        out.update(zip(others, self._others([self._text(x) for x in others]), strict=True))
        for piece, word, rest in joined:
            out[piece] = (out.get(word) or known[word]) + (out.get(rest) or known[rest])
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        cut, kept = [self.cut(x) for x in texts], self.kept
        missing = {piece for pieces in cut for piece in pieces if piece not in kept}
        if missing:
            found = self._fill(list(missing))
            kept.update(found)
        out = [b"".join(map(kept.__getitem__, pieces)) for pieces in cut]
        if missing:
            for piece in [piece for piece, ids in found.items() if len(ids) > 4 * LONGEST_KEPT]:
                del kept[piece]
            if len(kept) > MOST_KEPT:
                self.kept, self.older = {}, kept
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        try:
            out: list[bytes] = []
            a = size = 0
            for b, text in enumerate(texts):
                size += len(text)
                if size >= AT_ONCE:
                    out += self._some(texts[a : b + 1])
                    a, size = b + 1, 0
            return out + self._some(texts[a:])
        finally:
            if collecting:
                gc.enable()


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder for each worker process; kind: ``bytes`` or ``words``."""
    return PieceEncoder(path, byte_pieces) if kind == "bytes" else PieceEncoder(path, word_pieces, lower=True)

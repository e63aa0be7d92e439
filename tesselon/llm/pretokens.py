"""Pre-tokens and token ids of the tokenizers library, at the cost of a dictionary look-up a word.

The tokenizer of word_bpe_49k.json composes, lower-cases, and splits at white space and at changes of character class;
no pre-token crosses white space. So a text of plain Latin characters can be cut at white space and each distinct
chunk be passed to the library once a worker; every other text, and every text with an added token, goes to the
library whole. Nothing is truncated or padded.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
from tokenizers import Tokenizer

#: Texts of these characters are already composed, lower-case as str.lower does, and have no white space but blank, tab, LF and CR.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-±´-¸º»¿-įı-ňŊ-ž]*")
#: The tokenizer's own split, in Python's words, for those characters in lower case.
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Entries of a worker's dictionaries of chunks and of pieces: the first words met, so the frequent ones.
CHUNKS, PIECES = 1 << 18, 1 << 19
#: Entries of a worker's dictionary of chunks and the bytes of their ids, which are a fraction of the size of tuples.
PACKED = 1 << 19


@lru_cache(maxsize=4)
def worker(path: str) -> Worker:
    return Worker(path)


class Known(dict):
    """A dictionary that works out what it lacks, and keeps it while it has fewer than `most` entries."""

    def __init__(self, make, most: int = CHUNKS):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most:
            self[key] = value
        return value


def parts(chunk: str) -> list[str]:
    """SPLIT.findall, without a pattern for words that end in signs or in none."""
    if chunk.isalpha():
        return [chunk]
    word = chunk.rstrip(punctuation)
    if word.isalpha():
        return [word, chunk[len(word) :]]
    return SPLIT.findall(chunk)


class Worker:
    """One a Python worker, kept from task to task."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model  # the library makes a new object each time it is asked for
        self.mapped = Known(lambda c: "".join(self.pretokens(c)))
        self.pieces = Known(lambda chunk: tuple(map(self._mapped, parts(chunk))))
        self.piece_ids = Known(lambda piece: tuple(t.id for t in self.model.tokenize(self._mapped(piece))), PIECES)
        self.ids = Known(lambda chunk: tuple(chain.from_iterable(map(self.piece_ids.__getitem__, parts(chunk)))))
        self.blobs: dict[str, Known] = {}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of normalised text, as the library's pre-tokenizer gives them."""
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _mapped(self, piece: str) -> str:
        """A piece as the pre-tokenizer writes its bytes."""
        return piece if piece.isascii() else "".join(map(self.mapped.__getitem__, piece))

    def split(self, text: str) -> tuple[dict[str, int], int]:
        """Frequencies of a text's pre-tokens, and its number of added tokens (which stand for themselves)."""
        if self.plain(text):
            return Counter(chain.from_iterable(map(self.pieces.__getitem__, text.lower().split()))), 0
        freq: Counter = Counter()
        extra = 0
        whole = re.split("(" + "|".join(map(re.escape, self.added)) + ")", text) if self.added else [text]
        for k, part in enumerate(whole):
            if k % 2:
                extra += 1
            elif part:
                freq.update(self.pretokens(self.tok.normalizer.normalize_str(part)))
        return freq, extra

    def n_pieces(self, pretoken: str) -> int:
        return len(self.model.tokenize(pretoken))

    def _pack(self, chunk: str, known: Known, code: str) -> bytes:
        """The ids of a chunk. One of several pieces is put together from theirs, which are chunks too and kept in the same dictionary."""
        pieces = parts(chunk)
        if len(pieces) > 1:
            return b"".join([known[p] for p in pieces])
        return array(code, [t.id for t in self.model.tokenize(self._mapped(chunk))]).tobytes()

    def encode(self, text: str) -> list[int]:
        """Ids without begin and end, as encode(add_special_tokens=False) gives them."""
        if not self.plain(text):
            return self.tok.encode(text, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.ids.__getitem__, text.lower().split())))

    def packed(self, text: str, kind: str) -> bytes:
        """The ids of `encode` as integers of a numpy type, which has room for all ids of the vocabulary."""
        if not self.plain(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, kind).tobytes()
        known = self.blobs.get(kind)
        if known is None:
            code = np.dtype(kind).char
            known = self.blobs[kind] = Known(lambda chunk: self._pack(chunk, known, code), PACKED)
        return b"".join(map(known.__getitem__, text.lower().split()))

"""Exact tokenisation by the tokenizers library, with a bounded cache of the ids of text parts.

Both vocabularies split a text into pieces before they merge anything, so a text may be cut wherever such a split is
certain: at a space or line feed between two characters that are no white space. Each distinct part is encoded once by the
library and the ids are joined. Texts with a cut that isn't certain (runs of white space, unusual spaces beside a cut, a
space at either end) are encoded whole.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections.abc import Callable
from itertools import islice
from operator import attrgetter

import numpy as np

#: Parts in the cache (just below 2/3 of 2**19, where a dict doubles its table). When it is full, those stay that were met
#: in two of the sampled texts, since most words of a table are rare and wouldn't be met again.
MOST_PARTS = 349_000
#: A text of so many is a sample.
SAMPLED = 4
#: Parts of a text that are looked up at a time: far fewer than a full cache has room for.
STRETCH = 20_000
SEPARATOR = "<|endoftext|>"
#: Stands before a part that follows no space, in the keys of vocabularies that keep the space before a word.
MARK = "\x01"
#: A run of letters is one piece, so the library's merges can be called on it directly; so is a run of signs after it.
_LETTERS = re.compile(r"(\x01?([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+))([!-/:-@\[-`{-~]*)").fullmatch
_IDS = attrgetter("id")


def _byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_characters()


class _Uncertain(Exception):
    """A text holds a cut that isn't certain."""


class _Parts(dict):
    """Ids by part; a part that isn't there is learned."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        return self.learn(part)


class CachedTokenizer:
    """Ids of whole texts as little-endian unsigned 16- or 32-bit bytes, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, most: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        #: Byte-level vocabularies keep a space with the word after it; the others drop white space.
        self.keeps_space = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        self.most = most or MOST_PARTS
        self.parts = _Parts(self._learn)
        #: Parts met in sampled texts since the cache was full, and those met in two of them.
        self.seen: set[str] = set()
        self.again: set[str] = set()
        self.texts = 0
        #: The parts of the stretch at hand.
        self.cut: list[str] = []

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _spelled(self, part: str) -> str:
        """The stretch of text that a part stands for."""
        if not self.keeps_space or part == "\n":
            return part
        return part[1:] if part[:1] == MARK else " " + part

    def _certain(self, part: str) -> bool:
        inner = part[1:] if part[:1] == MARK else part
        return inner == "\n" or bool(inner) and inner == inner.strip()

    def _keep(self, part: str, ids: bytes) -> None:
        if len(self.parts) >= self.most:
            kept = {p: self.parts[p] for p in islice(self.again, self.most // 2) if p in self.parts}
            self.parts.clear()
            self.parts.update(kept)
            self.seen, self.again = set(), set()
        self.parts[part] = ids

    def _sample(self) -> None:
        if len(self.seen) < self.most // 2:
            here = set(self.cut)
            self.again |= here & self.seen
            self.seen |= here

    def _library(self, parts: list[str]) -> list[bytes]:
        """Encodes parts that don't contain the separator in one call per block: a special token always ends a piece."""
        out = []
        for k in range(0, len(parts), 2048):
            block = parts[k : k + 2048]
            ids = np.array(self.tokenizer.encode(SEPARATOR.join(map(self._spelled, block)), add_special_tokens=False).ids, dtype=np.int64)
            ends = np.append(np.flatnonzero(ids == self.separator), len(ids))
            raw, width = ids.astype(self.dtype), self.dtype.itemsize
            if len(ends) != len(block):
                raise AssertionError("a part holds the separator")
            data, first = raw.tobytes(), 0
            for end in ends.tolist():
                out.append(data[first * width : end * width])
                first = end + 1
        return out

    def _learn(self, part: str) -> bytes:
        """The ids of a part that isn't in the cache; signs after letters are a piece of their own."""
        if m := _LETTERS(part):
            stem, letters, signs = m.groups()
            if signs:
                common = stem in self.parts
                end = MARK + signs if self.keeps_space else signs
                if (tail := self.parts.get(end)) is None:
                    tail = self._library([end])[0]
                    self._keep(end, tail)
                ids = self.parts[stem] + tail
                if common:  # a rare word is kept without its signs only
                    self._keep(part, ids)
                return ids
            # a run of letters, after a space or not, straight from the library's merges
            if not self.keeps_space:
                letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(_BYTES)
            if self.keeps_space and stem[0] != MARK:
                letters = "\u0120" + letters
            ids = array(self.code, map(_IDS, self.model.tokenize(letters))).tobytes()
            self._keep(part, ids)
            return ids
        if not self._certain(part):
            raise _Uncertain
        # what else the stretch has of this kind goes to the library in the same call
        rest = [p for p in {part, *self.cut} if p not in self.parts and not _LETTERS(p) and self._certain(p)]
        found = dict(zip(rest, self._library(rest), strict=True))
        for p, ids in found.items():
            self._keep(p, ids)
        return found[part]

    def _cuts(self, text: str) -> list[str]:
        if self.keeps_space:
            return (MARK + text.replace("\n", " \n " + MARK)).split(" ")
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        out = []
        for text in texts:
            if not text or MARK in text or SEPARATOR in text:
                out.append(self._whole(text))
                continue
            cuts, ids = self._cuts(text), []
            try:
                for k in range(0, len(cuts), STRETCH):
                    self.cut = cuts[k : k + STRETCH]
                    ids.append(b"".join(map(self.parts.__getitem__, self.cut)))
                out.append(b"".join(ids))
            except _Uncertain:
                out.append(self._whole(text))
            self.texts += 1
            if self.texts % SAMPLED == 0:
                self._sample()
        self.cut = []
        return out


_LOADED: dict[str, CachedTokenizer] = {}


def tokenizer(path: str, most: int | None = None) -> CachedTokenizer:
    """The process's tokenizer for a vocabulary file; Python workers that are used again keep its cache (of ``most`` parts)."""
    found = _LOADED.get(path)
    if found is None or most and found.most != most:
        _LOADED.clear()
        found = _LOADED[path] = CachedTokenizer(path, most)
    return found


def release() -> None:
    """Lets the process's tokenizer and its cache go: a worker that is used again for other work needs the memory."""
    if not _LOADED:
        return
    _LOADED.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return

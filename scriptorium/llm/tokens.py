"""Exact, fast use of the public tokenizers: each distinct pre-token is encoded once per worker.

Both supported vocabularies cut a text into pre-tokens that are encoded
independently, so a text's ids are the ids of its pre-tokens in order. For
texts of ASCII and Latin letters the cut is done by one regular expression
here, and ids come from a bounded cache whose misses go to the library in one
call. Any other text goes to the library whole, as does one that spells out an
added token of the vocabulary, which the library reads as that token.
"""

from __future__ import annotations

import codecs
import os
import re
from functools import cached_property

import numpy as np

#: Latin letters that need no Unicode normalisation and lower one to one (without U+0130).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
PLAIN = re.compile(rf"[\x09\x0a\x0d\x20-\x7e{LETTERS}]*")
#: Pre-tokens of the byte-level vocabulary; a white-space run leaves its last blank to the next word.
BYTE_CUT = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
)
#: Pre-tokens of the lower-case word vocabulary; white space falls away.
WORD_CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+")
SEPARATOR, BREAK = "\x01", " "
CACHE_SIZE = 700_000


def byte_alphabet() -> str:
    """The byte-level vocabularies' letter of each byte: printable ones stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


#: As the alphabet, but byte 2 becomes the break between pre-tokens; no letter of the alphabet is a blank.
LETTER = byte_alphabet()[:2] + BREAK + byte_alphabet()[3:]


def byte_level(text: str) -> str:
    return codecs.charmap_decode(text.encode(), "strict", LETTER)[0]


class FastTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the library's own."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE, plain_added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.cache_size, self.plain_added = path, cache_size, plain_added
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = plain_added
        self.added = [] if plain_added else [t.content for t in self.pieces.get_added_tokens_decoder().values()]
        self.words = self.pieces.normalizer is not None
        if self.words:
            self.pieces.normalizer = None  # given lower-case plain text only; nothing is left to normalise
        self.pieces.pre_tokenizer = pre_tokenizers.Split(BREAK, "removed")  # bytes are mapped before
        self.cut = (WORD_CUT if self.words else BYTE_CUT).findall
        ids = self.pieces.encode(byte_level(SEPARATOR), add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None
        self.cache: dict[str, bytes] = {}

    @cached_property
    def library(self):
        """The library's own tokenizer for texts that are not plain, told only whether added tokens' names are plain text."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = self.plain_added
        return library

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if self.mark is None or not PLAIN.fullmatch(text) or any(t in text for t in self.added):
                ids = self.library.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4").tobytes())
                continue
            parts = self.cut(text.lower() if self.words else text)
            missing = set(parts).difference(self.cache)
            if missing:
                self._learn(list(missing))
            out.append(b"".join(map(self.cache.__getitem__, parts)))
            if len(self.cache) > self.cache_size:
                self._forget()
        return out

    def encode_parts(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Ids of a plain text without added tokens, and how many letters and ids each of its pre-tokens has."""
        parts = self.cut(text)
        missing = set(parts).difference(self.cache)
        if missing:
            self._learn(list(missing))
        found = list(map(self.cache.__getitem__, parts))
        if len(self.cache) > self.cache_size:
            self._forget()
        letters, size = (np.fromiter(map(len, x), dtype=np.int64, count=len(parts)) for x in (parts, found))
        return b"".join(found), letters, size // 4

    def _forget(self) -> None:
        """Drop the longest pre-tokens, down to half the cache: short ones come again sooner."""
        lengths = sorted(map(len, self.cache))
        most = lengths[self.cache_size // 2] - 1
        self.cache = {part: ids for part, ids in self.cache.items() if len(part) <= most}

    def _learn(self, parts: list[str]) -> None:
        joined = byte_level(f"\x02{SEPARATOR}\x02".join(parts))
        ids = np.array(self.pieces.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.mark)
        starts = [0, *((ends + 1) * 4).tolist()]
        stops = [*(ends * 4).tolist(), len(ids) * 4]
        raw = ids.tobytes()
        self.cache.update(zip(parts, (raw[a:b] for a, b in zip(starts, stops, strict=True)), strict=True))


_LOADED: dict[tuple[str, int, bool], FastTokenizer] = {}


def tokenizer(path: str, cache_size: int = CACHE_SIZE, plain_added: bool = False) -> FastTokenizer:
    """The tokenizer of a file, loaded once per worker; with ``plain_added`` added tokens' names in a text are plain text."""
    key = (path, cache_size, plain_added)
    if key not in _LOADED:
        _LOADED[key] = FastTokenizer(path, cache_size, plain_added)
    return _LOADED[key]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

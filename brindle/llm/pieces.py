"""Cached byte-level BPE: texts are cut where no pre-token can span, and each distinct part is encoded once a worker.

A space or line break with no other white space beside it always starts a pre-token, so `a b` may be cut into `a`, ` b` without
changing any id. Parts seen before come from a bounded cache; new parts are cut by the pre-token pattern, and new pre-tokens
are encoded by the BPE model of the tokenizers library. Texts or parts with characters on which regex engines may disagree
(outside Latin letters, odd controls, superscript digits) go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain
from struct import pack

#: The library's byte table: printable bytes stand for themselves, others are moved up to 256 and on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_TO_CHAR: dict[int, str] = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(_PLAIN))}
CHAR_TO_BYTE: dict[str, int] = {c: b for b, c in BYTE_TO_CHAR.items()}

_ADJACENT = re.compile(r"[\s᠎​﻿]{2}")
_SAFE = re.compile(r"[\t-\r -~¡-±´-¸º»¿-ɏ]*").fullmatch
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def mapped(part: str) -> str:
    """The part's UTF-8 bytes in the library's byte-to-character form."""
    if part.isascii() and part.isprintable():
        return part.replace(" ", "Ġ")
    return part.encode().decode("latin-1").translate(BYTE_TO_CHAR)


class PieceCoder:
    """value(ids) of each part, cached in two generations of about `limit` entries: what a full young one held and is asked again moves over,
    the rest is forgotten. No result depends on what is held."""

    def __init__(self, tokenizer, value: Callable[[list[int]], object], join: Callable, known: dict | None = None, special: tuple[str, ...] = (), limit: int = 300_000):
        self.tokenizer, self.value, self.join, self.special, self.limit = tokenizer, value, join, special, limit
        self.model, self.known = tokenizer.model, known or {}
        self.parts: dict[str, object] = dict(self.known)
        self.old: dict[str, object] = {}

    def whole(self, text: str):
        return self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pre(self, word: str):
        """A pre-token is a part of its own, so either is looked up among all."""
        got = self.parts.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                got = self.value([t.id for t in self.model.tokenize(mapped(word))])
            self.parts[word] = got
        return got

    def _part(self, part: str):
        got = self.old.get(part)
        if got is None:
            if part.isascii() and part.isprintable() or _SAFE(part):
                words = _PRE(part)
                if len(words) == 1:
                    return self._pre(part)
                got = self.join(map(self._pre, words))
            else:
                got = self.whole(part)
        self.parts[part] = got
        return got

    def cut(self, text: str) -> list[str]:
        """Parts whose concatenation is the text and between which no pre-token spans."""
        if "\0" in text or _ADJACENT.search(text):
            return _PRE(text) if _SAFE(text) else [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str):
        """join() of the values of the text's parts."""
        if any(s in text for s in self.special):
            return self.whole(text)
        if len(self.parts) > self.limit + len(self.known):
            self.old, self.parts = self.parts, dict(self.known)
        parts, cut = self.parts, self.cut(text)
        if len(cut) == 1:
            return self._part(text) if len(text) < 64 else self._alone(text)
        for p in [p for p in set(cut) if p not in parts]:
            self._part(p)
        return self.join(map(parts.__getitem__, cut))

    def _alone(self, text: str):
        return self.join(map(self._pre, _PRE(text))) if _SAFE(text) else self.whole(text)


_held: dict[tuple, object] = {}


def of_worker(key: tuple, make: Callable[[], object], most: int = 3):
    """What make() gives, held by this Python worker for the tasks that follow: a tokenizer and its caches are built once a worker.
    At most `most` of them are held; each bounds itself."""
    if key not in _held:
        while len(_held) >= most:
            _held.pop(next(iter(_held)))
        _held[key] = make()
    return _held[key]


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return pack(f"<{len(ids)}I", *ids)


def bytes_coder(tokenizer, special: tuple[str, ...] = (), limit: int = 300_000) -> PieceCoder:
    return PieceCoder(tokenizer, as_bytes, b"".join, special=special, limit=limit)


def length_coder(tokenizer, known: dict[str, int], special: tuple[str, ...] = (), limit: int = 300_000) -> PieceCoder:
    return PieceCoder(tokenizer, len, sum, known=known, special=special, limit=limit)


def special_strings(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def flat(lists) -> list[int]:
    return list(chain.from_iterable(lists))

"""Ids of whole texts from ids of pre-tokens, each distinct pre-token encoded once while it is remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex


class PretokenIds:
    """encode_many: pre-tokens -> lists of ids. Ids are kept as little-endian unsigned 32-bit bytes.

    The memory is emptied at `limit` pre-tokens, so a worker's memory is bounded whatever the vocabulary.
    """

    def __init__(self, pattern: str, encode_many: Callable[[list[str]], Iterable[list[int]]], limit: int = 200_000):
        self.find, self.encode_many, self.limit = regex.compile(pattern).findall, encode_many, limit
        self.known: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if len(self.known) > self.limit:
            self.known.clear()
        found = [self.find(text) for text in texts]
        new = list(set().union(*found).difference(self.known)) if found else []
        if new:
            self.known.update(zip(new, (np.array(ids, dtype="<u4").tobytes() for ids in self.encode_many(new)), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, words)) for words in found]
        for word in new:
            if len(word) > 64:  # rarely met again
                self.known.pop(word, None)
        return out

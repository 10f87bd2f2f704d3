"""64-bit hashes of words, remembered by each Python worker."""

from __future__ import annotations

import numpy as np
import xxhash

from statloom.llm.common import lowered

#: Words a worker remembers.
REMEMBERED = 200_000


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


KNOWN = Words()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def split(text: bytes) -> list[bytes]:
    """Runs other than ASCII white space, A-Z lowered."""
    return lowered(text).split()

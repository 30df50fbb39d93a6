"""Hashes of words and of word sequences inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import xxhash

from tallyspark.llm.common import KEPT, mix64

#: Words whose hash a worker keeps while it works on a partition, about 130 bytes each; when there are more, it starts anew.
KEPT_WORDS = 250_000


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_KNOWN = _Known()


def forgetting(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition's function that leaves no words behind: workers outlive their partitions and stages.

    What an earlier stage's work left in the worker goes first.
    """

    def wrapped(batches: Iterator) -> Iterator:
        for kept in KEPT:
            kept.clear()
        try:
            yield from run(batches)
        finally:
            _KNOWN.clear()

    return wrapped


def word_hashes(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several documents in a row, and each document's word count."""
    if len(_KNOWN) > KEPT_WORDS:
        _KNOWN.clear()
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    every = map(_KNOWN.__getitem__, chain.from_iterable(split))
    return np.fromiter(every, dtype=np.uint64, count=int(counts.sum())), counts


def sequence_hashes(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at each position plus the given offsets, as far as they reach."""
    size = max(0, len(hashes) - max(offsets))
    total = np.full(size, len(offsets), dtype=np.uint64)
    for offset in offsets:
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + hashes[offset : offset + size])
    return total

"""Suffix order of a text inside one task, by a difference cover modulo 3."""

from __future__ import annotations

import numpy as np


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of the rows of some columns of small non-negative integers."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + column
    return np.unique(key, return_inverse=True)[1] + 1


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``codes`` (integers above 0) in ascending order.

    Triples at the positions that 3 does not divide are sorted and named; where
    names repeat, the order of the text of names, found the same way, settles
    it. The other suffixes are sorted by their first code and the rank of what
    follows, and merged.
    """
    n = len(codes)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: codes[i:].tolist()), dtype=np.int64)
    s = np.concatenate([codes.astype(np.int64), np.zeros(3, np.int64)])
    # with n = 1 (mod 3) the empty suffix at n is a sample too, and sorts first
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names = _names(s[sample], s[sample + 1], s[sample + 2])
    if int(names.max()) < len(sample):
        order = suffix_array(names)
    else:
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    sorted_sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    before = sorted_sample[sorted_sample % 3 == 1] - 1
    zeros = before[np.argsort(s[before], kind="stable")]
    sorted_sample = sorted_sample[sorted_sample < n]
    one, two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    width = n + 3
    below_one = np.searchsorted(s[one] * width + rank[one + 1], s[zeros] * width + rank[zeros + 1])
    both = np.concatenate([zeros, two])
    most = int(s.max()) + 1
    if most * most * width < 1 << 62:
        pair = (s[both] * most + s[both + 1]) * width + rank[both + 2]
    else:
        pair = _names(s[both], s[both + 1]) * width + rank[both + 2]
    below_two = np.searchsorted(pair[len(zeros) :], pair[: len(zeros)])
    place = np.arange(len(zeros)) + below_one + below_two
    merged = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    merged[place] = zeros
    merged[free] = sorted_sample
    return merged


def repeated_starts(
    texts: list[bytes], low: np.ndarray, high: np.ndarray, length: int
) -> list[np.ndarray]:
    """For each text, where strings of ``length`` bytes start that start at another place, too.

    Texts are excerpts that may overlap: byte i of a text stands at the place
    ``low + i``, and if the same excerpt stands elsewhere, at ``high + i``, too.
    Equal strings are neighbours in suffix order; neighbours' prefixes are
    compared eight bytes at a time.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    n = int((sizes + 1).sum())
    data = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
    codes = data[:n].astype(np.int64) + 2
    codes[starts + sizes] = 1  # ends of texts
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    offset = np.arange(n) - starts[owner]
    order = suffix_array(codes)
    order = order[(offset + length <= sizes[owner])[order]]
    if not len(order):
        return [np.empty(0, np.int64)] * len(texts)
    words = data[:n].astype(np.uint64)
    for shift in range(1, 8):
        words |= data[shift : n + shift].astype(np.uint64) << np.uint64(8 * shift)
    equal = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for step in dict.fromkeys(reversed(steps)):
        equal = equal[words[order[equal] + step] == words[order[equal + 1] + step]]
    if length < 8:
        part = words & np.uint64((1 << 8 * length) - 1)
        equal = equal[part[order[equal]] == part[order[equal + 1]]]
    begins = np.ones(len(order), bool)
    begins[equal + 1] = False
    runs = np.flatnonzero(begins)
    least = np.minimum.reduceat(low[owner[order]] + offset[order], runs)
    most = np.maximum.reduceat(high[owner[order]] + offset[order], runs)
    hit = np.zeros(n, bool)
    hit[order] = (least != most)[np.cumsum(begins) - 1]
    return [np.flatnonzero(hit[s : s + z]) for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]

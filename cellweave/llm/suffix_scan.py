"""Byte-level kernels of the suffix-array dedup: names of substrings, sampled suffixes and their stretches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes of the first ranks, and of the repeated string that counts.
FIRST, LENGTH = 16, 50

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


@lru_cache(2)
def _letters(which: int) -> np.ndarray:
    return np.random.default_rng(1000 + which).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of them."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base = int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (out[0], out[1])
    return have


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Names:
    """64-bit names of any substrings of one byte row; equal substrings have equal names."""

    def __init__(self, row: np.ndarray, which: int = 0):
        n = len(row)
        power, self.inverse = _powers(which, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters(which)[row] * power[:n], dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Names of all substrings of ``size`` bytes."""
        m = len(self.prefix) - size
        return scramble((self.prefix[size:] - self.prefix[:m]) * self.inverse[:m] + np.uint64(size))


def sampled_suffixes(rank: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` ranks the place of its least rank (of its upper 40 bits), the leftmost of equals."""
    n = len(rank)
    if n >= 1 << 24:  # long rows go in overlapping parts, as a place must fit into 24 bits
        step = (1 << 24) - width
        parts = [sampled_suffixes(rank[i : i + step + width - 1], width) + i for i in range(0, n - width + 1, step)]
        return np.concatenate(parts)
    low = np.uint64((1 << 24) - 1)
    value, size = (rank & ~low) | np.arange(n, dtype=np.uint64), 1
    while size < width:  # minima over windows that double
        step = min(size, width - size)
        value = np.minimum(value[: len(value) - step], value[step:])
        size += step
    return (value & low).astype(np.int64)


def stretches(row: np.ndarray, bounds: np.ndarray, first: int = FIRST, length: int = LENGTH):
    """Sampled suffixes of the texts row[bounds[i]:bounds[i+1]]: (ranks, name, from, to, text) arrays, in the order of the row.

    The starts of all ``length``-byte strings of a text fall into stretches from..to, one for each sampled suffix that is the
    least of its window. ``name`` names all bytes row[from : to + length] of the stretch, so two stretches with one name hold
    the same strings. ``ranks`` has the name of the suffix's first ``first`` bytes in its upper 40 bits; below, 12 bits each
    name the bytes that double it to the left and to the right, or are 0 where no string of the stretch holds them. Two equal
    strings always lie in stretches whose upper 40 bits agree, and the string holds one of the doubled ones. No ``ranks`` is -1.
    """
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    if not count.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    names = Names(row)
    rank = names.every(first)
    text = np.repeat(np.arange(len(count)), count)
    start = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    at = sampled_suffixes(rank, length - first + 1)[start]  # windows across texts are left out
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    one = np.flatnonzero(new)
    begin, place, text = start[one], at[one], text[one]
    end = start[np.append(one[1:], len(at)) - 1]
    more, twelve = (length - first) // 2, np.uint64(0xFFF)
    left_ok, right_ok = begin <= place - more, end + length >= place + first + more
    left = names.of(np.where(left_ok, place - more, place), place + first) & twelve | np.uint64(1)
    right = names.of(place, np.where(right_ok, place + first + more, place)) & twelve | np.uint64(1)
    right = np.where(right == twelve, np.uint64(1), right)
    ranks = rank[place] & ~np.uint64(0xFFFFFF) | np.where(left_ok, left << np.uint64(12), np.uint64(0))
    ranks |= np.where(right_ok, right, np.uint64(0))
    name = Names(row, 1).of(begin, end + length)
    return ranks.view(np.int64), name.view(np.int64), begin, end, text


def string_pairs(row: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For strings at ``starts``: the name of their first half and that of the half at the offset where it ends."""
    names, half = Names(row), length // 2
    return names.of(starts, starts + half).view(np.int64), names.of(starts + half, starts + length).view(np.int64)

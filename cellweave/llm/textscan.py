"""Vectorised views of a batch of texts as one row of bytes or code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cellweave.llm.suffix_scan import Names, scramble

_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """2 for letters, 1 for marks, which combine with them, and 0 for all else."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        out[i] = 2 if kind == "L" else kind == "M"
    return out


def mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Fold the codes ``c`` into the running 32-bit hashes ``h``."""
    h = (h ^ c) * _M1
    return h ^ (h >> np.uint32(15))


def gram_hashes(c: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash of c[i:i+n] for every i at which it fits."""
    m = len(c) - n + 1
    h = np.full(m, (salt * int(_M2) + int(_M3)) & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = mix(h, c[k : k + m])
    return h


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def run_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run c[start:end]; runs must be disjoint and ordered."""
    if not len(starts):
        return np.empty(0, np.uint32)
    lengths = ends - starts
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = c[np.repeat(starts, lengths) + at]
    weights = mix(at.astype(np.uint32) * _M2, np.full(1, _M3, np.uint32)) | np.uint32(1)
    summed = np.add.reduceat(mix(codes, np.zeros(1, np.uint32)) * weights, np.cumsum(lengths) - lengths, dtype=np.uint32)
    return mix(summed, lengths.astype(np.uint32))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along the first axis; empty segments are 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Chunks of more bytes are named as a whole.
_FOLDED = 64
#: Bytes of the texts that are looked at together.
BLOCK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[9:14] = 32  # white space


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """The column in slices of at most ``size`` bytes (a longer text is alone) and 256 texts."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        fits = int(np.searchsorted(total, (total[i - 1] if i else 0) + size, side="right"))
        j = min(max(fits, i + 1), i + 256)
        yield texts.slice(i, j - i)
        i = j


#: Characters of a text, or of several short ones, that are looked at together.
PART = BLOCK_BYTES // 4


def cuts(text: str, size: int = PART) -> list[tuple[int, int]]:
    """Where the parts of a text begin and end: at most ``size`` characters, the last of them a space or line break if one is there."""
    out, at = [], 0
    while len(text) - at > size:
        end = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size)) + 1
        end = end if end > at else at + size
        out.append((at, end))
        at = end
    return [*out, (at, len(text))]


def parts(texts: list[str | None], size: int = PART) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The parts of all texts in groups of at most ``size`` characters and 256 parts, and the number of the text of each."""
    owner, group, room = [], [], size
    for i, text in enumerate(texts):
        for a, b in cuts(text or "", size):
            if group and (b - a > room or len(group) == 256):
                yield np.array(owner), group
                owner, group, room = [], [], size
            owner.append(i)
            group.append((text or "")[a:b])
            room -= b - a
    if group:
        yield np.array(owner), group


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts as one row (null: none), and the bounds of each text in it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    row = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    return row, bounds - bounds[0]


def chunk_bounds(texts: pa.Array, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes of all texts; start, end and text of each chunk that spaces (after the folding) part.

    Without another table, A-Z are folded to lower case and ASCII white space to spaces.
    """
    row, bounds = text_bytes(texts)
    row = fold[row]
    inside = row != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(row))]  # a chunk ends with its text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    start = np.flatnonzero(first)
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, bounds)))
    return row, start, np.flatnonzero(last) + 1, owner


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def chunk_names(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name, not 0, of each row[start:end]: eight bytes are folded in at a time, long ones are named as a whole."""
    size = end - start
    eight = np.ndarray((len(row),), np.uint64, np.append(row, np.zeros(8, np.uint8)), 0, (1,))
    name = scramble(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(size <= _FOLDED)
    for k in range(0, _FOLDED, 8):
        left = size[live] - k
        part = eight[start[live] + k] & _LOW_BYTES[np.minimum(left, 8)]
        name[live] = scramble(name[live] ^ part) + part
        live = live[left > 8]
        if not len(live):
            break
    long = np.flatnonzero(size > _FOLDED)
    if len(long):
        name[long] = Names(row).of(start[long], end[long])
    return np.where(name, name, np.uint64(1))


class NameTable:
    """Numbers of names, in the order in which they come: an open table that doubles when it is half full."""

    def __init__(self, bits: int = 16):
        self.slots, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.size = 0

    def find(self, names: np.ndarray) -> np.ndarray:
        """-1 for names that are not there."""
        mask = len(self.slots) - 1
        slot = (names & np.uint64(mask)).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == names, self.number[slot], np.int32(-1))
        live = np.flatnonzero((held != names) & (held != 0))
        while len(live):
            slot = (slot if len(slot) == len(live) else slot[live]) + 1 & mask
            held = self.slots[slot]
            hit = held == names[live]
            out[live[hit]] = self.number[slot[hit]]
            on = ~hit & (held != 0)
            live, slot = live[on], slot[on]
        return out

    def add(self, names: np.ndarray) -> None:
        """Names must be new and different from each other."""
        if 2 * (self.size + len(names)) > len(self.slots):
            there = self.slots != 0
            known, number = self.slots[there], self.number[there]
            bits = int(2 * (self.size + len(names))).bit_length() + 1
            self.slots, self.number = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._put(known, number)
        self._put(names, np.arange(self.size, self.size + len(names), dtype=np.int32))
        self.size += len(names)

    def _put(self, names: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (names & np.uint64(mask)).astype(np.int64)
        while len(names):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = names[free]  # of names that meet in a slot one stays
            mine = free & (self.slots[slot] == names)
            self.number[slot[mine]] = number[mine]
            names, number, slot = names[~mine], number[~mine], slot[~mine] + 1 & mask

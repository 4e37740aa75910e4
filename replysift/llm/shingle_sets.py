"""Sets of word shingles: hashes, digests, exact links, parity sketches and what they rule out.

A sketch is an optional head (the bytes of a MinHash signature) and parities: bit
``h mod size`` tells whether an odd number of shingles falls there, at least two bits for a shingle.
Every shingle that two sets don't share changes one bit, so the bits in which two
sketches differ are a lower bound of the difference, and a pair above the bound can't link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

from .common import mix64
from .text_stats import word_ids

_ODD = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles."""
    words = text.lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    ids = word_ids(words)
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, dict.fromkeys(words)), np.uint64)[ids]
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, _ODD[60 - size], np.uint64)
    for i in range(size):
        total += of_word[i:len(words) - size + 1 + i] * _ODD[i % 50]
        total = mix64(total) if i % 4 == 3 else total
    return np.unique(mix64(total))


def set_hash(shingle_set: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingle_set.tobytes()) - (1 << 63)


def set_digest(shingle_set: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return xxhash.xxh3_128_digest(shingle_set.tobytes())


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or den * small < num * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return den * common >= num * (small + large - common)


def sketch(shingle_set: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits; at least two bits for a shingle, a power of two."""
    bits = 1 << max(6, int(2 * len(shingle_set) - 1).bit_length())
    place = (shingle_set & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words folded to ``width`` words."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, width), axis=1)


def differing_bits(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the size of the other."""
    return int(Sketches([a], 0).differing(b, np.zeros(1, np.int64))[0])


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``den * |A & B| >= num * |A | B|``; candidates may differ in ``most`` of
    the ``head`` first bytes of their sketches."""

    num: int
    den: int
    head: int = 0
    most: int = 0

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def bits_fit(self, differing, a, b):
        return differing * (self.den + self.num) <= (self.den - self.num) * (a + b)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        return linked(a, b, self.num, self.den)


def may_link(na: int, a: bytes, nb: int, b: bytes, num: int, den: int) -> bool:
    """False only if the two sets certainly don't link."""
    rule = Rule(num, den)
    return bool(rule.sizes_fit(na, nb) and rule.bits_fit(differing_bits(a, b), na, nb))


class Sketches:
    """Sketches of many sets as matrices, one for each length."""

    def __init__(self, sketches: list[bytes], head: int):
        self.head = head
        self.heads = np.frombuffer(b"".join(s[:head] for s in sketches), np.uint8).reshape(-1, head) if head else None
        lengths = np.array([len(s) - head for s in sketches], np.int64)
        self.place, self.matrix = np.zeros(len(sketches), np.int64), {}
        self.words = lengths // 8
        for size in np.unique(lengths):
            rows = np.flatnonzero(lengths == size)
            self.place[rows] = np.arange(len(rows))
            self.matrix[int(size) // 8] = np.frombuffer(b"".join(sketches[i][head:] for i in rows), np.uint64).reshape(len(rows), -1)

    def _at(self, size: int, width: int) -> np.ndarray:
        """The matrix of ``size`` words folded to ``width``."""
        if (size, width) not in self.matrix:
            self.matrix[size, width] = _folded(self.matrix[size], width)
        return self.matrix[size, width]

    def differing(self, other: bytes, rows: np.ndarray) -> np.ndarray:
        """Differing parities of some rows with one sketch."""
        own = np.frombuffer(other[self.head:], np.uint64)[None, :]
        out = np.zeros(len(rows), np.int64)
        for size in np.unique(self.words[rows]):
            some = np.flatnonzero(self.words[rows] == size)
            width = min(int(size), own.shape[1])
            left = self.matrix[int(size)] if width == size else self._at(int(size), width)
            right = own if width == own.shape[1] else _folded(own, width)
            out[some] = np.bitwise_count(left[self.place[rows[some]]] ^ right).sum(axis=1)
        return out

    def hits(self, n: int, other: bytes, sizes: np.ndarray, rule: Rule, among: np.ndarray) -> np.ndarray:
        """Which of the rows ``among`` may link with a set of ``n`` shingles."""
        rows = among[rule.sizes_fit(sizes[among], n)]
        if rule.head and len(rows):
            rows = rows[(self.heads[rows] != np.frombuffer(other[:rule.head], np.uint8)).sum(axis=1) <= rule.most]
        return rows[rule.bits_fit(self.differing(other, rows), sizes[rows], n)] if len(rows) else rows


def pairs_may_link(na: np.ndarray, a: list[bytes], nb: np.ndarray, b: list[bytes], rule: Rule) -> np.ndarray:
    """For each pair whether it may link."""
    keep = rule.sizes_fit(na, nb)
    if rule.head:
        heads = [np.frombuffer(b"".join(s[:rule.head] for s in side), np.uint8).reshape(-1, rule.head) for side in (a, b)]
        keep &= (heads[0] != heads[1]).sum(axis=1) <= rule.most
    shape = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2) - rule.head
    for la, lb in np.unique(shape[keep], axis=0):
        rows = np.flatnonzero(keep & (shape[:, 0] == la) & (shape[:, 1] == lb))
        width = int(min(la, lb)) // 8
        left, right = (_folded(np.frombuffer(b"".join(side[i][rule.head:] for i in rows), np.uint64).reshape(len(rows), -1), width) for side in (a, b))
        keep[rows] = rule.bits_fit(np.bitwise_count(left ^ right).sum(axis=1).astype(np.int64), na[rows], nb[rows])
    return keep

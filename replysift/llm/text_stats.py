"""Counts over one document's bytes that several operators use."""

from __future__ import annotations

import numpy as np

BLANK_BYTES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SYMBOL_BYTES = np.frombuffer(b"#*$%&|<>", np.uint8)


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def code_points(counts: np.ndarray) -> int:
    """Characters: bytes that don't continue one (0x80-0xBF do)."""
    return int(counts[:128].sum() + counts[192:].sum())


def word_ids(words: list[bytes]) -> np.ndarray:
    """A small number for each distinct word, in order of first use."""
    distinct = dict.fromkeys(words)
    ids = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a three-word window that occurs twice or more (the first occurrence too)."""
    n = len(ids) - 2
    if n < 2:
        return 0
    size = int(ids.max()) + 1
    grams = ids[:-2] * size + ids[1:-1]
    if size >= 1 << 20:  # keeps the product below 2**63
        grams = np.unique(grams, return_inverse=True)[1]
    grams = grams * size + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = np.diff(grams[order]) == 0
    if not same.any():
        return 0
    starts = order[np.append(same, False) | np.append(False, same)]
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[starts + i] = True
    return int(covered.sum())


def longest_run(ids: np.ndarray) -> int:
    """Most times that one word follows itself."""
    if not len(ids):
        return 0
    ends = np.flatnonzero(np.append(np.diff(ids) != 0, True))
    return int(np.diff(np.append(-1, ends)).max())


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += 1
        elif line.split(None, 1):
            seen.add(line)
    return n

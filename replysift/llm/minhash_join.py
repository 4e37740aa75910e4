"""MinHash near-dedup (11): multi-index Hamming join over b-bit signatures.

A document is the set of its distinct ``n``-word shingles (A-Z lower-cased); with fewer words
the whole sequence is one shingle; without words the set is empty and linked with nothing. Two sets
link when ``den * |A & B| >= num * |A | B|``.

Signature. ``VALUES`` MinHash values of 8 bits each: one byte of the least of the set's hashes
under each of as many hash functions. Two sets of Jaccard similarity J differ in each value with probability
(1 - J) * 255/256, so the distance (values that differ) of a linking pair is ``distance`` at most, but
for one pair in ``1 / MISS`` just at the limit; ``distance`` follows from num/den, VALUES and MISS.

Join. All pairs of signatures within that distance are found for certain: the values are cut into
``distance // 2 + 1`` chunks, so by the pigeonhole principle one chunk has at most one error. The allowed
errors are enumerated by leaving out each value of a chunk in turn: chunks with at most one error
agree in one of these. A signature has ``VALUES`` such keys, whatever the distance.

Verifying. Candidates that share a key must be within the distance, then pass a bound from the
parities of their shingles, then link on their full sets (``settle``: components by smallest ids,
hot groups in blocks, copies one node).

Defined cases: a null or empty text has no shingles and is its own component; equal texts are
linked; rows that repeat an id count as one document; a row without an id is left out of the
components, gets none and is kept; an empty table gives an empty result; other columns stay out of the
report, and ``near_duplicates_removed`` returns the columns it was given.
"""

from __future__ import annotations

from functools import lru_cache, partial
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, quoted, read_table
from .settle import keys_from_heads, linked_components
from .shingle_sets import Rule

VALUES = 64
#: Share of linking pairs just at the limit whose signatures may be farther apart than the distance.
MISS = 1e-4
_FACTORS = mix64(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SLICE = 4096  # shingles hashed at once


@lru_cache(maxsize=None)
def distance_of(num: int, den: int, values: int = VALUES, miss: float = MISS) -> int:
    """Least distance that a pair at the limit exceeds with probability ``miss`` at most."""
    p = (1 - num / den) * 255 / 256
    left = 1.0
    for d in range(values + 1):
        left -= comb(values, d) * p**d * (1 - p) ** (values - d)
        if left <= miss:
            return d
    return values


def minhashes(shingle_set: np.ndarray) -> np.ndarray:
    """The signature: one byte for each hash function."""
    least = np.full(VALUES, np.uint64(2**64 - 1))
    for start in range(0, len(shingle_set), _SLICE):
        hashed = shingle_set[None, start:start + _SLICE] * _FACTORS[:, None]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        least = np.minimum(least, hashed.min(axis=1))
    return (mix64(least) & np.uint64(255)).astype(np.uint8)


@lru_cache(maxsize=None)
def _chunks(distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value: its chunk, its shift inside the chunk; and the chunks' widths."""
    count = distance // 2 + 1
    if -(-VALUES // count) > 8:
        raise ValueError("a chunk would not fit in 64 bits: the distance is too small for this many values")
    widths = np.full(count, VALUES // count)
    widths[:VALUES % count] += 1
    chunk = np.repeat(np.arange(count), widths)
    shift = (np.arange(VALUES) - np.repeat(np.cumsum(widths) - widths, widths)) * 8
    return chunk, shift.astype(np.uint64), widths


def chunk_keys(signatures: np.ndarray, distance: int) -> np.ndarray:
    """For each signature (a row) the keys of its chunks with each value left out."""
    chunk, shift, widths = _chunks(distance)
    shifted = signatures.astype(np.uint64) << shift
    whole = np.bitwise_or.reduceat(shifted, np.cumsum(widths) - widths, axis=1)
    left = whole[:, chunk] & ~(np.uint64(255) << shift)
    return mix64(left ^ mix64(np.arange(1, VALUES + 1, dtype=np.uint64)))


def _heads(sets: list[np.ndarray]) -> list[bytes]:
    return [minhashes(s).tobytes() for s in sets]


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    distance = distance_of(num, den)
    keys = keys_from_heads(VALUES, partial(chunk_keys, distance=distance))
    found = linked_components(docs, n, _heads, keys, Rule(num, den, VALUES, distance), id_col, text_col)
    return found.withColumn("kept", quoted(id_col).eqNullSafe(F.col("component_id")))


def near_duplicates_removed(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the rows of the smallest id of each component (all rows of that id) and those without an id."""
    gone = near_duplicates(docs, n, num, den, id_col, text_col).where("not kept").select(quoted(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs["`" + id_col + "`"].cast("long") == gone["__gone"], "left_anti")


def q_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=85, den=100)

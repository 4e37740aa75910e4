"""D3, learned: does an answer read like the others? Log likelihood of its character transitions.

Letters a to z stand for themselves, any other letter for ``~``, and a run of everything else for one
blank: 28 symbols, so a table of 784 transition weights whatever the data. Weights are
learned from a listing's own valid answers in one aggregate with partial sums, add one to each count, and are
whole thousandths of a natural logarithm, so that scores are exact integers on any engine and in
any order of summation. Spark reduces texts to symbols; their pairs are looked up in tasks, a batch at a time. An answer is noise if its mean weight lies ``margin`` below that of all
transitions learned from. Every character of every text counts, none is sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .text import col_of, named

SYMBOLS = " abcdefghijklmnopqrstuvwxyz~"
MARGIN = 900  # thousandths
LEAST_PAIRS = 12
_STRETCH = 1 << 20  # pairs handled at once
_PLACE = np.zeros(256, np.uint8)
_PLACE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))


def symbols(text: Column) -> Column:
    """The text in the 28 symbols, without blanks at its ends; null: empty."""
    letters = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}]+", " ")
    return F.trim(F.regexp_replace(letters, "[^a-z ]", "~"))


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends, codes): texts of symbols as one run of places in ``SYMBOLS``, and where each text ends in it."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], _PLACE[raw]


def _pairs(codes: np.ndarray, start: int, end: int) -> np.ndarray:
    """For each pair of neighbours in a stretch 28 times the place of the first plus that of the second."""
    some = codes[start:end].astype(np.int16)
    return some[:-1] * 28 + some[1:]


def count_pairs(texts: pa.Array) -> np.ndarray:
    """How often each of the 784 transitions occurs in texts of symbols."""
    ends, codes = _codes(texts)
    out = np.zeros(784, np.int64)
    for start in range(0, len(codes) - 1, _STRETCH):
        out += np.bincount(_pairs(codes, start, start + _STRETCH + 1), minlength=784)
    # pairs of one text's end and the next one's beginning don't count
    joints = np.unique(ends)
    joints = joints[(joints > 0) & (joints < len(codes))]
    return out - np.bincount(codes[joints - 1].astype(np.int64) * 28 + codes[joints], minlength=784)


def sum_pairs(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, total) of each text of symbols: its transitions and the sum of their weights."""
    ends, codes = _codes(texts)
    pairs, total = np.maximum(np.diff(ends) - 1, 0), np.zeros(len(texts), np.int64)
    first, last = ends[:-1], ends[:-1] + pairs  # of each text's pairs in the run of all
    for start in range(0, len(codes) - 1, _STRETCH):
        upto = np.concatenate([[0], np.cumsum(weights[_pairs(codes, start, start + _STRETCH + 1)])])
        a, b = np.searchsorted(last, start, "right"), np.searchsorted(first, start + len(upto) - 1, "left")
        total[a:b] += upto[np.clip(last[a:b] - start, 0, len(upto) - 1)] - upto[np.clip(first[a:b] - start, 0, len(upto) - 1)]
    return pairs, total


class _Scorer:
    def __init__(self, weights: tuple[int, ...]):
        self.weights = weights

    def __call__(self, texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sum_pairs(texts, np.array(self.weights, np.int64))], ["pairs", "total"])


@dataclass(frozen=True)
class Transitions:
    """784 weights in thousandths and the mean of all transitions learned from (rounded down)."""

    weights: tuple[int, ...]
    mean: int
    margin: int = MARGIN

    def score(self, text: Column | str) -> Column:
        """Struct(pairs, total): transitions of the text and the sum of their weights."""
        ship_package(SparkSession.active())
        scorer = _Scorer(self.weights)

        def run(texts: pa.Array) -> pa.Array:
            return scorer(texts)

        return F.arrow_udf(run, "struct<pairs:bigint,total:bigint>")(symbols(col_of(text)))

    def is_noise(self, text: Column | str, least_pairs: int = LEAST_PAIRS) -> Column:
        """True for texts of ``least_pairs`` transitions or more that read unlike the rest; short ones pass."""
        return self.tells_noise(self.score(text), least_pairs)

    def tells_noise(self, score: Column, least_pairs: int = LEAST_PAIRS) -> Column:
        """``is_noise`` of a text whose score is there already."""
        return (score["pairs"] >= least_pairs) & (score["total"] < score["pairs"] * (self.mean - self.margin))


def learn_transitions(df: DataFrame, text_col: str, margin: int = MARGIN) -> Transitions:
    """Weights from all texts of a column; what reaches the driver is 784 rows at most."""
    import math

    ship_package(df.sparkSession)

    def run(batches):
        counts = np.zeros(784, np.int64)
        for batch in batches:
            counts += count_pairs(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(counts)).cast(pa.int32()), pa.array(counts[counts > 0])], ["pair", "n"])

    counted = df.select(symbols(named(text_col)).alias("t")).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    seen = {r["pair"]: r["n"] for r in counted.collect()}
    firsts = [sum(seen.get(28 * a + b, 0) for b in range(28)) for a in range(28)]
    # floor(x + 0.5): the same rounding everywhere
    weights = tuple(math.floor(1000 * math.log((seen.get(28 * a + b, 0) + 1) / (firsts[a] + 28)) + 0.5) for a in range(28) for b in range(28))
    total = sum(seen.values())
    mean = sum(n * weights[p] for p, n in seen.items()) // total if total else 0
    return Transitions(weights, mean, margin)

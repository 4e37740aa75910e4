"""Quality classifier (3): histogram gradient-boosted trees over document statistics.

Fitting: a sample of at most ``max_rows`` labelled documents (least hashes of the
ids; the bound is a parameter) gives a matrix of ``FEATURES``; each feature is cut
into at most ``N_BINS`` bins at its quantiles, and trees of fixed depth are grown
level by level from per-node histograms of gradients and curvatures. Scoring: all
trees lie flat in three arrays (feature, threshold, leaf value) and every batch
of documents walks all trees at once, one numpy step for each level.

Only the text is an input of a score. Defined cases: a null or empty text has
all-zero statistics and is scored like any other; several labels of one document
count by their least quality; without any usable label every score is 0.5;
repeated rows get the same score; a document without an id is never used to fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, map_texts, quoted
from .text_stats import BLANK_BYTES, SYMBOL_BYTES, code_points, longest_run, repeated_lines, repeated_words, word_ids

MAX_ROWS = 20_000
N_BINS, DEPTH, TREES, RATE, LEAST_WEIGHT, SHRINK = 48, 4, 80, 0.15, 4.0, 2.0


def _table(*codes) -> np.ndarray:
    """Marks byte values."""
    table = np.zeros(256, bool)
    for c in codes:
        table[c] = True
    return table


_CAPITAL, _SMALL, _HIGH, _DIGIT = _table(slice(65, 91)), _table(slice(97, 123)), _table(slice(128, 256)), _table(slice(48, 58))
_SYMBOL, _BLANK = _table(SYMBOL_BYTES), _table(BLANK_BYTES)
_MARK, _END = _table(np.frombuffer(b".,;:!?'\"()-", np.uint8)), _table(np.frombuffer(b".!?:;\"')", np.uint8))
_LETTER = _CAPITAL | _SMALL | _HIGH

FEATURES = (
    "log_words", "chars_per_word", "letters", "capitals", "digits", "symbols", "marks", "exclamations", "blanks",
    "distinct_words", "top_word", "longest_run", "repeated_trigrams", "repeated_lines", "words_per_line", "ended_lines",
    "short_lines", "words_without_letters", "capital_words", "symbol_words", "longest_word", "worst_line_symbols",
    "worst_line_capitals", "worst_line_repeats", "bad_words",
)


def statistics(text: bytes) -> list[float]:
    """The values of ``FEATURES`` for one document."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    total = len(data)
    blank = np.concatenate(([True], _BLANK[data], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]  # of words, end exclusive
    sizes = ends - starts
    ids = word_ids(words)
    frequency = np.bincount(ids)
    # lines with a word: sums from prefix sums at the line ends
    breaks = np.flatnonzero(data == 10)
    of_word = np.searchsorted(breaks, starts)  # line of each word
    present, first_word, line_words = np.unique(of_word, return_index=True, return_counts=True)
    bounds = np.concatenate(([0], breaks + 1, [total + 1]))
    lo, hi = bounds[present], np.minimum(bounds[present + 1] - 1, total)

    def in_lines(table):
        sums = np.concatenate(([0], np.cumsum(table[data])))
        return sums[hi] - sums[lo]

    capitals, letters_ascii, symbols = in_lines(_CAPITAL), in_lines(_CAPITAL | _SMALL), in_lines(_SYMBOL)
    distinct = np.bincount(np.searchsorted(present, np.unique(of_word * (len(frequency)) + ids) // len(frequency)), minlength=len(present))
    long = line_words >= 4
    line_symbols = np.where(long, symbols / np.maximum(1, hi - lo), 0)
    line_capitals = np.where(long, capitals / np.maximum(1, letters_ascii), 0)
    line_repeats = np.where(long, 1 - distinct / line_words, 0)
    bad = (line_symbols > 0.05) | (line_capitals > 0.6) | ((line_words >= 8) & (line_repeats > 0.7))
    last = data[ends - 1]
    last_of_line = last[first_word + line_words - 1]
    n_lines = len(present)
    ascii_letters = int(letters_ascii.sum())
    return [
        float(np.log1p(n)), (code_points(counts) - int(counts[BLANK_BYTES].sum())) / n,
        (ascii_letters + int(counts[128:].sum())) / total, int(capitals.sum()) / max(1, ascii_letters),
        int(counts[_DIGIT].sum()) / total, int(counts[_SYMBOL].sum()) / total, int(counts[_MARK].sum()) / total,
        int(counts[33]) / n, int(counts[_BLANK].sum()) / total, len(frequency) / n, int(frequency.max()) / n,
        longest_run(ids) / n, repeated_words(ids) / n, repeated_lines(text.split(b"\n")) / n_lines, n / n_lines,
        float(_END[last_of_line].mean()), 1 - float(long.mean()), 1 - float(_LETTER[data[starts]].mean()),
        sum(map(bytes.isupper, words)) / n, float(_SYMBOL[last].mean()), float(sizes.max()),
        float(line_symbols.max()), float(line_capitals.max()), float(line_repeats.max()), int(line_words[bad].sum()) / n,
    ]


class Trees:
    """A fitted ensemble: complete trees of one depth, flat in arrays."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        if not n_trees or not len(x):
            return np.full(len(x), self.base)
        rows, trees = np.arange(len(x))[:, None], np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[trees, node - inner].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_bins: int = N_BINS, depth: int = DEPTH, trees: int = TREES,
              rate: float = RATE, least_weight: float = LEAST_WEIGHT, shrink: float = SHRINK) -> Trees:
    """Logistic loss, second-order leaf values. Same input, same trees (no random part)."""
    inner, leaves = 2 ** depth - 1, 2 ** depth
    p = (float(y.sum()) + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p))) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)])  # bin b: x <= edges[b]
    cells = binned + np.arange(m) * n_bins
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, curve = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2 ** level
            at = (node[:, None] * (m * n_bins) + cells).ravel()
            g = np.bincount(at, np.repeat(grad, m), width * m * n_bins).reshape(width, m, n_bins)
            h = np.bincount(at, np.repeat(curve, m), width * m * n_bins).reshape(width, m, n_bins)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl ** 2 / (hl + shrink) + (ga - gl) ** 2 / (ha - hl + shrink) - ga ** 2 / (ha + shrink)
            gain[(hl < least_weight) | (ha - hl < least_weight)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            chosen, cut = best // n_bins, best % n_bins
            for i in range(width):
                if top[i] > 1e-9 and cut[i] < len(edges[chosen[i]]):
                    feature[t, width - 1 + i], threshold[t, width - 1 + i] = chosen[i], edges[chosen[i]][cut[i]]
            own = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, own]] > threshold[t, own])
        g, h = np.bincount(node, grad, leaves), np.bincount(node, curve, leaves)
        leaf[t] = -rate * g / (h + shrink)
        margin += leaf[t][node]
    return Trees(base, feature, threshold, leaf)


def sample_labels(labels: DataFrame, label_col: str, usable, id_col: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, y) of at most ``max_rows`` labelled ids for which ``usable`` holds: those with the least hashes."""
    one = labels.where(quoted(label_col).isNotNull() & usable).groupBy(quoted(id_col).alias("__id")).agg(F.min(quoted(label_col)).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)


class _Statistics:
    def __call__(self, texts):
        return [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]


def fit_quality(docs: DataFrame, labels: DataFrame, usable, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", max_rows: int = MAX_ROWS) -> Trees:
    """Fits on the labelled documents for which ``usable`` (a column of ``labels``) holds.
    What reaches the driver is ``max_rows`` rows of statistics; documents that repeat an id
    are bounded the same way."""
    chosen = F.broadcast(sample_labels(labels, label_col, usable, id_col, max_rows))  # max_rows narrow rows
    known = docs.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text")).join(chosen, "__id")
    made = map_texts(known, "x array<double>", _Statistics(), "__text", keep=["__id", "y"])
    rows = made.orderBy(F.xxhash64("__id"), "__id").limit(max_rows).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["y"].to_numpy(float))


class _Score:
    def __init__(self, trees: Trees):
        self.trees = trees

    def __call__(self, texts):
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return [pa.array(self.trees.predict(x), pa.float64())]


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 (higher: better); no shuffle."""
    return map_texts(docs, f"`{score_col}` double", _Score(trees), text_col)


def usable_fold():
    """Rows of ``labels`` that may be learned from: crc32 of the id mod 5 is not 0."""
    return F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), 5) != 0)


def q_gbt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_quality(docs, labels, usable_fold()))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

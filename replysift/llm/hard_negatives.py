"""Hard-negative mining (12): angular triangle filtering before integer scoring.

A row's vector is scaled and floored to integers; the score of two rows is their integer
inner product. For each anchor the ``positives`` best rows of its label are its positives, and
for each of those the ``negatives`` best rows of other labels whose score lies in the window
``low/100 * positive <= score <= high/100 * positive`` are its hard negatives (higher scores first,
ties by the smaller id).

How. Each vector keeps its norm and its angles to a few reference directions. Angles on a
sphere obey the triangle inequality, so for an anchor a, a row x and a reference r
``|t(a,r) - t(x,r)| <= t(a,x) <= min(t(a,r) + t(x,r), 2 pi - t(a,r) - t(x,r))``; the tightest interval over all
references, through the cosine and times both norms, bounds the score from both sides, widened
by more than the rounding of its arithmetic. Rows lie in blocks around the nearest reference, so
an anchor first meets the interval of a whole block. Integer scores are made only where the
interval can reach the anchor's threshold (positives: the k-th greatest lower bound seen) or
overlaps one of its windows (negatives).

References are chosen on a sample of ``SAMPLE`` rows (least hashes of the id), the
next always farthest from those chosen; they decide speed, never results.

Scale. Rows are dealt into blocks of about ``BLOCK_ROWS``, anchors into blocks of about
``BLOCK_ANCHORS``, and each pair of blocks is one group of one task: its memory has a
bound, whatever the sizes of labels or of groups of equal vectors. A tile returns at most k rows for each anchor and
window, and the k best of all tiles are taken by a window that cuts before its shuffle.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take
no part, nor do vectors so long that a score could leave 64 bits (squared integer norm of 2**61
or more); vectors of different lengths are compared as if padded with zeros; an empty or zero vector scores 0;
rows that repeat an id are rows of their own; an anchor without positives, or without rows
in a window, has no output; a negative positive score has an empty window; other columns
are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, quoted, read_table, ship_package, stage

REFERENCES = 16
SAMPLE = 1024
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 2048
LIMIT = float(2**61)
#: Angles are exact to about 1e-8 (the arc cosine near 0 and pi); cosines of them so too.
SLACK = 1e-6
_SLICE = 64  # anchors bounded at once


def integers(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of the integer components and ``usable`` for each row."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    value = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        value = np.floor(scale * value)
        bad = np.bincount(row, weights=~np.isfinite(value), minlength=len(column)) > 0
        value = np.where(np.isfinite(value), value, 0.0)
        bad |= np.bincount(row, weights=value * value, minlength=len(column)) >= LIMIT
    usable = column.is_valid().to_numpy(zero_copy_only=False) & ~bad
    return row, place, np.where(usable[row], value, 0.0), usable


def references(rows: DataFrame, scale: int, count: int = REFERENCES) -> np.ndarray:
    """Unit vectors, each next one farthest from those before, from a bounded sample."""
    sample = rows.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    column = sample.column(0).combine_chunks()
    row, place, value, usable = integers(column, scale)
    vectors = np.zeros((len(column), int(place.max(initial=-1)) + 1))
    vectors[row, place] = value
    norms = np.linalg.norm(vectors, axis=1)
    vectors = vectors[norms > 0] / norms[norms > 0, None]
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def with_angles(rows: DataFrame, refs: np.ndarray, scale: int) -> DataFrame:
    """(rid, id, label, ints, norm, angles, near) of the rows (id, label, vector) that take part."""
    ship_package(rows.sparkSession)
    ddl = "rid long, id long, label long, ints binary, norm double, angles array<double>, near int"
    target = arrow_schema(ddl)

    def run(batches):
        from pyspark import TaskContext

        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            row, place, value, usable = integers(batch.column(2), scale)
            usable &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            n = batch.num_rows
            norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
            angles = np.zeros((n, len(refs)))
            for r, ref in enumerate(refs):
                known = place < len(ref)
                dot = np.bincount(row[known], weights=value[known] * ref[place[known]], minlength=n)
                angles[:, r] = np.arccos(np.clip(dot / np.maximum(norm, 1.0), -1.0, 1.0))
            near = np.argmin(angles, axis=1) if len(refs) else np.zeros(n, np.int64)
            ends = np.searchsorted(row, np.arange(n + 1))
            small = value.astype(np.int32)
            keep = np.flatnonzero(usable)
            yield pa.RecordBatch.from_arrays([
                pa.array(done + keep), batch.column(0).take(keep).cast(pa.int64()), batch.column(1).take(keep).cast(pa.int64()),
                pa.array([small[ends[i]:ends[i + 1]].tobytes() for i in keep], pa.binary()), pa.array(norm[keep]),
                pa.array(list(angles[keep]), pa.list_(pa.float64())), pa.array(near[keep], pa.int32())], schema=target)
            done += n

    return rows.select("id", "label", "vector").mapInArrow(run, ddl)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    parts = column.to_pylist()
    out = np.zeros((len(parts), width), np.int64)
    for i, part in enumerate(parts):
        own = np.frombuffer(part, np.int32)
        out[i, :len(own)] = own
    return out


class Side:
    """Rows of one side of a tile: numpy columns of a table."""

    def __init__(self, table: pa.Table, width: int):
        self.rid, self.id, self.label, self.norm = (table.column(c).to_numpy() for c in ("rid", "id", "label", "norm"))
        self.ints = _matrix(table.column("ints"), width)
        flat = table.column("angles").combine_chunks().flatten().to_numpy()
        self.angles = flat.reshape(len(self.rid), -1)


def _width(*tables: pa.Table) -> int:
    return max((pa.compute.max(pa.compute.binary_length(t.column("ints"))).as_py() or 0) for t in tables) // 4


def block_reach(a: Side, x: Side) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor bounds of its scores with all rows of ``x``, from the block's intervals."""
    low, high = x.angles.min(axis=0), x.angles.max(axis=0)
    gap = np.maximum(np.maximum(low - a.angles, a.angles - high), 0).max(axis=1, initial=0.0)
    far = np.minimum(a.angles + high, 2 * np.pi - a.angles - low).min(axis=1, initial=np.pi)
    up, down = np.cos(np.maximum(gap - SLACK, 0)), np.cos(np.minimum(far + SLACK, np.pi))
    least, most = a.norm * x.norm.min(), a.norm * x.norm.max()
    upper, lower = np.where(up > 0, up * most, up * least), np.where(down > 0, down * least, down * most)
    return lower - 1 - 1e-9 * most, upper + 1 + 1e-9 * most


def score_bounds(angles: np.ndarray, norms: np.ndarray, x: Side) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of the scores of anchors with rows, safe under rounding."""
    gap = np.zeros((len(norms), len(x.norm)))
    far = np.full_like(gap, np.pi)
    for r in range(angles.shape[1]):
        t, u = angles[:, r, None], x.angles[None, :, r]
        np.maximum(gap, np.abs(t - u), out=gap)
        both = t + u
        np.minimum(far, np.minimum(both, 2 * np.pi - both), out=far)
    size = norms[:, None] * x.norm[None, :]
    room = 1 + 1e-9 * size
    return size * np.cos(np.minimum(far + SLACK, np.pi)) - room, size * np.cos(np.maximum(gap - SLACK, 0)) + room


def scores(vectors: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; floats hold them exactly while ``exact``."""
    if exact:
        return (vectors.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
    return vectors @ anchor  # wraps in between, but the sums themselves fit


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, higher scores first, ties by id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= floor)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def tile_positives(a: Side, x: Side, k: int) -> tuple[list, int]:
    """((anchor rid, id, score) of each anchor's k best rows of its label in the tile, pairs scored)."""
    out, scored = [], 0
    exact = float(a.norm.max()) * float(x.norm.max()) < 2**52
    for start in range(0, len(a.rid), _SLICE):
        some = slice(start, start + _SLICE)
        lower, upper = score_bounds(a.angles[some], a.norm[some], x)
        for i in range(lower.shape[0]):
            own = start + i
            peers = np.flatnonzero((x.label == a.label[own]) & (x.rid != a.rid[own]))
            if len(peers) > k:  # the k-th greatest lower bound is reached by k rows
                reach = np.partition(lower[i, peers], len(peers) - k)[len(peers) - k]
                peers = peers[upper[i, peers] >= reach]
            if len(peers):
                found = scores(x.ints[peers], a.ints[own], exact)
                scored += len(peers)
                out += [(int(a.rid[own]), int(x.id[peers[j]]), int(found[j])) for j in _best(found, x.id[peers], k)]
    return out, scored


def tile_negatives(a: Side, x: Side, windows: list, k: int) -> tuple[list, int]:
    """((anchor rid, place, id, score) of the k best rows of other labels in each window, pairs scored).

    ``windows``: for each anchor a list of (place, low, high)."""
    out, scored = [], 0
    exact = float(a.norm.max()) * float(x.norm.max()) < 2**52
    low = np.array([min((w[1] for w in ws), default=1) for ws in windows], np.float64)
    high = np.array([max((w[2] for w in ws), default=0) for ws in windows], np.float64)
    block_low, block_high = block_reach(a, x)
    # as floats the ends of a window may be off by rounding: bounds have more room than that
    left = np.flatnonzero((low <= high) & (block_high >= low) & (block_low <= high))
    for start in range(0, len(left), _SLICE):
        some = left[start:start + _SLICE]
        lower, upper = score_bounds(a.angles[some], a.norm[some], x)
        for i, own in enumerate(some):
            rows = np.flatnonzero((x.label != a.label[own]) & (upper[i] >= low[own]) & (lower[i] <= high[own]))
            if not len(rows):
                continue
            found = scores(x.ints[rows], a.ints[own], exact)
            scored += len(rows)
            for place, least, most in windows[own]:
                fits = np.flatnonzero((found >= least) & (found <= most))
                ids, score = x.id[rows[fits]], found[fits]
                out += [(int(a.rid[own]), place, int(ids[j]), int(score[j])) for j in _best(score, ids, k)]
    return out, scored


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``: (nearest reference, part), parts of about BLOCK_ROWS dealt evenly."""
    sizes = rows.groupBy("near").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))  # a row for each reference
    part = F.pmod(F.xxhash64("rid"), F.col("parts"))
    return rows.join(F.broadcast(sizes), "near").withColumn("block", F.struct("near", part.alias("part"))).drop("near", "parts")


def _tiles(blocks: DataFrame, anchors: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(anchors, rows)`` for every anchor block and row block, one group for each pair."""
    n = max(1, -(-anchors.count() // BLOCK_ANCHORS))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = blocks.select("block").distinct().withColumn("deal", every)
    left = anchors.withColumn("deal", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")).join(pairs, "deal")
    right = blocks.withColumn("deal", every)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own: both sides come from one table
    target = arrow_schema(schema)

    def run(anchor_table: pa.Table, row_table: pa.Table) -> pa.Table:
        if not anchor_table.num_rows or not row_table.num_rows:
            return target.empty_table()
        found = fn(anchor_table, row_table)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), target, strict=True)], schema=target) if found else target.empty_table()

    return left.groupBy("block", "deal").cogroup(right.groupBy("block", "deal")).applyInArrow(run, schema)


def mine(rows: DataFrame, is_anchor, scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows``
    (id, label, vector); ``is_anchor``: a condition on id."""
    if not 0 <= low <= high:
        raise ValueError("low and high are percentages, 0 <= low <= high")
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    vectors = stage(with_angles(rows, references(rows, scale), scale), "mine-vectors")
    blocks = _blocked(vectors)
    anchors = vectors.where(is_anchor).drop("near")

    def best_positives(a: pa.Table, x: pa.Table) -> list:
        width = _width(a, x)
        return tile_positives(Side(a, width), Side(x, width), positives)[0]

    by_anchor = W.partitionBy("rid").orderBy(F.col("score").desc(), "other")
    chosen = _tiles(blocks, anchors, best_positives, "rid long, other long, score long")
    chosen = stage(chosen.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives), "mine-positives")

    # the windows of an anchor: at most ``positives`` of them
    ends = chosen.where("score >= 0").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("windows"))
    with_windows = anchors.join(ends, "rid")

    def best_negatives(a: pa.Table, x: pa.Table) -> list:
        width = _width(a, x)
        windows = [[(w["place"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in ws] for ws in a.column("windows").to_pylist()]
        return tile_negatives(Side(a, width), Side(x, width), windows, negatives)[0]

    by_window = W.partitionBy("rid", "place").orderBy(F.col("found").desc(), "negative_id")
    hard = _tiles(blocks, with_windows, best_negatives, "rid long, place int, negative_id long, found long")
    hard = hard.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    known = chosen.join(anchors.select("rid", F.col("id").alias("anchor_id")), "rid")
    return hard.join(known, ["rid", "place"]).select(
        "anchor_id", F.col("other").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id",
        F.col("score").alias("positive_score"), F.col("found").alias("negative_score"))


def q_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(quoted("vec_id").alias("id"), quoted("label").alias("label"), quoted("embedding").alias("vector"))
    shifted = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), F.col("id") % 100 == 0)

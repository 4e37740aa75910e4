import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from replysift.llm import hard_negatives as hn

SCHEMA = "id long, label int, vector array<float>"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in ints) < 2**61:
            good.append((i, label, ints))
    out = Counter()
    for n, (i, label, v) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, own) for m, (j, own, w) in enumerate(good) if m != n)
        for minus, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and -low * minus <= -100 * s[0] <= -high * minus]
            out.update((i, j, rank, k, -minus, -s) for rank, (s, k, _) in enumerate(fits[:negatives], 1))
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return Counter(map(tuple, hn.mine(df, F.col("id") % 10 == 0, **options).collect()))


def cluster_rows(rng, n, labels, dims=6, spread=0.4):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, i % labels, [c + rng.gauss(0, spread) for c in centres[rng.randrange(labels)]]) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"positives": 2, "negatives": 7, "low": 10}, {"low": 95, "high": 130}])
def test_equals_scoring_all(spark, options, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 7)
    rows = cluster_rows(random.Random(1), 300, 3)
    want = brute(rows, lambda i: i % 10 == 0, **options)
    assert mined(spark, rows, **options) == want and len(want) > 50


def test_ties_hot_label_and_equal_vectors(spark):
    """A third of all rows are one vector; ids decide ties."""
    rng = random.Random(2)
    rows = [(i, 0 if i % 3 else 1, [0.5, 0.5, 0.5]) if i % 3 != 2 else (i, rng.randrange(3), [rng.uniform(-1, 1) for _ in range(3)]) for i in range(200)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want and sum(want.values()) > 100


def test_odd_rows(spark):
    long = [0.01] * 5000
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0, 3.0]), (2, 2, [1.0, 1.5]), (3, 2, []), (4, 2, [0.0, 0.0]), (10, 1, []), (10, 1, []), (20, 2, [0.0]),
            (5, None, [1.0]), (None, 1, [1.0]), (6, 1, None), (7, 1, [1.0, None]), (8, 2, [float("nan"), 1.0]), (9, 2, [float("inf")]),
            (30, 1, [3e38, 1.0]), (40, 1, [1e6, -1e6]), (41, 2, [9e5, -1e6]), (42, 1, [8e5, -1.1e6]), (50, 3, long), (51, 3, long), (52, 1, long),
            (60, 5, [1.0, 1.0]), (70, 1, [-1.0, -1.0]), (2, 2, [1.0, 1.5])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    flat = [r for r in rows if r[0] in (3, 4, 20)] + [(30, 7, [])]  # no direction at all
    assert mined(spark, flat) == brute(flat, lambda i: i % 10 == 0)
    assert mined(spark, []) == Counter()


def test_query_ignores_other_columns_and_no_anchor(spark, tmp_dir):
    rows = spark.createDataFrame([(1, [1.0, 0.5], 3), (2, [1.0, 0.4], 3)], "vec_id long, embedding array<float>, label int")
    rows.withColumns({"rid": F.lit("own"), "near": F.lit(1), "vector": F.lit("x")}).write.parquet(f"{tmp_dir}/embeddings.parquet")
    assert hn.q_hard_negatives(spark, tmp_dir).collect() == []


def _side(ids, labels, vectors, refs):
    width = max(map(len, vectors))
    ints = [np.floor(256 * np.array(v)).astype(np.int32) for v in vectors]
    norm = [float(np.linalg.norm(v.astype(float))) for v in ints]
    angles = [[float(np.arccos(np.clip(v[:len(r)].astype(float) @ r[:len(v)] / max(n, 1), -1, 1))) for r in refs] for v, n in zip(ints, norm, strict=True)]
    return hn.Side(pa.table({"rid": ids, "id": ids, "label": labels, "norm": norm, "ints": [v.tobytes() for v in ints],
                             "angles": pa.array(angles, pa.list_(pa.float64()))}), width)


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(3)
    for dims in (2, 5, 40):
        centres = rng.normal(size=(4, dims))
        vectors = [centres[i % 4] + 0.15 * rng.normal(size=dims) for i in range(200)] + [np.zeros(dims), centres[0], centres[0], -centres[0], 2 * centres[1]]
        refs = [c / np.linalg.norm(c) for c in centres]
        x = _side(list(range(len(vectors))), [i % 5 for i in range(len(vectors))], vectors, refs)
        lower, upper = hn.score_bounds(x.angles, x.norm, x)
        exact = x.ints @ x.ints.T
        assert (lower <= exact).all() and (exact <= upper).all()
        low, high = hn.block_reach(x, x)
        assert (low <= exact.min(axis=1)).all() and (exact.max(axis=1) <= high).all()
        _, scored = hn.tile_positives(x, x, 2)
        peers = sum(int(((x.label == c).sum() - 1) * (x.label == c).sum()) for c in range(5))
        assert scored < peers * (0.7 if dims < 40 else 1.01)

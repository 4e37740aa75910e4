import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from odd import ROWS, no_documents, odd_documents
from replysift.llm import mixing as mx


def by_highest_quotients(wanted, seats):
    got = [0] * len(wanted)
    for _ in range(seats):
        i = max(range(len(wanted)), key=lambda i: (wanted[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_sainte_lague_equals_seat_by_seat():
    rng = random.Random(6)
    for _ in range(200):
        wanted = [rng.choice([0, 1, 1, 5, 17, 100, rng.random() * 50]) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 60)
        if sum(wanted) > 0:
            assert mx.sainte_lague(wanted, seats).tolist() == by_highest_quotients([float(w) for w in wanted], seats)
    assert mx.sainte_lague([], 4).tolist() == [] and mx.sainte_lague([0.0, 0.0], 4).tolist() == [0, 0]


def test_targets_are_filled_by_weight():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randint(1, 8)
        sizes, weights = [rng.choice([0, 1, 10, 500, 90000]) for _ in range(n)], [i % 3 + 1 for i in range(n)]
        got = mx.targets(sizes, weights)
        assert abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
        rates = [Fraction(g) / w for g, s, w in zip(got, sizes, weights, strict=True) if g < 3 * s]
        assert all(g <= 3 * s for g, s in zip(got, sizes, strict=True))
        assert all(abs(r - rates[0]) < 1e-6 for r in rates)
        assert all(3 * s <= w * (rates[0] if rates else 1e9) + 1e-6 for g, s, w in zip(got, sizes, weights, strict=True) if g == 3 * s and s)


def documents(spark, parts):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None, "é", ""])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)


def test_each_source_meets_its_target(spark):
    rows, df = documents(spark, 3)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mx.targets([size[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    for shard in (20_000, 40):
        out = mx.mix_sources(mx.sized(df), docs_per_shard=shard, block_words=16).collect()
        taken = Counter()
        for r in out:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r["size"] and r.target == want[r.source] and r.source_size == size[r.source]
            assert r.taken == sum(x["to"] - x["from"] for x in r.spans)
        assert len(out) == len(rows)
        for s in want:
            assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 32, (s, taken[s], want[s])


def test_reruns_agree_whatever_the_layout(spark):
    a = mx.mix_sources(mx.sized(documents(spark, 1)[1])).select("doc_id", "taken", "shard").collect()
    b = mx.mix_sources(mx.sized(documents(spark, 7)[1])).select("doc_id", "taken", "shard").collect()
    c = mx.mix_sources(mx.sized(documents(spark, 7)[1]), seed="other").select("doc_id", "taken", "shard").collect()
    assert set(a) == set(b) != set(c)


def test_mixed_texts_hold_the_taken_words(spark):
    rows = [(i, "\n".join(f"d{i}w{k}" for k in range(30)), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mx.mix_sources(mx.sized(df), weights=lambda s: [5, 1], block_words=8)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    found = defaultdict(int)
    for r in mx.mixed_documents(mixed).collect():
        words = r.text.split()
        assert r.text == "\n".join(words) and all(w.startswith(f"d{r.doc_id}w") for w in words)
        found[r.doc_id] += len(words)
    assert {k: v for k, v in taken.items() if v} == dict(found)


def test_ring_counts_by_hand(spark):
    """The spans of one shard are exactly its arc of words, going round."""
    rows = [(i, " ".join(["w"] * (i % 5)), "s") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mx.mix_sources(mx.sized(df), block_words=7).collect()
    assert sum(r.taken for r in out) in range(sum(i % 5 for i in range(50)) - 7, sum(i % 5 for i in range(50)) + 8)


def test_odd_documents(spark):
    docs = odd_documents(spark, ("Taken", "shard", "w", "spans"))
    out = mx.mix_sources(mx.sized(docs)).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len((r[1] or "").encode().split())) for r in ROWS)
    assert all(r.taken <= 3 * r["size"] for r in out)
    assert len({r.source_size for r in out if r.source is None}) == 1
    assert mx.mixed_documents(mx.mix_sources(mx.sized(docs))).count() > 0
    assert mx.mix_sources(mx.sized(no_documents(spark))).count() == 0
    many = spark.createDataFrame([(i, "a", str(i)) for i in range(9)], "doc_id long, text string, source string")
    import pytest

    with pytest.raises(ValueError):
        mx.mix_sources(mx.sized(many), max_sources=8)
    assert np.isfinite([r.target for r in out]).all()

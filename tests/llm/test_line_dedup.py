import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from odd import ROWS, no_documents, odd_documents
from replysift.llm import line_dedup as ld

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(BLANKS).translate({i: i + 32 for i in range(65, 91)})


def brute(texts, least):
    count = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[key(x)] < least]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def random_texts(n=300):
    rng = random.Random(2)
    pool = [f" Line {i} " if i % 3 else f"LINE {i}" for i in range(40)] + ["", "\t", "é È"]
    return ["\n".join(rng.choice(pool) if rng.random() < 0.7 else str(rng.random()) for _ in range(rng.randint(1, 8))) for _ in range(n)]


@pytest.mark.parametrize("limit", [ld.BROADCAST_BYTES, 0])
def test_equals_brute_force_both_ways(spark, limit):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(df, 10, broadcast_bytes=limit).collect()}
    assert got == dict(enumerate(brute(texts, 10)))


@pytest.mark.parametrize("limit", [ld.BROADCAST_BYTES, 0])
def test_odd_documents(spark, limit):
    out = ld.dedup_lines(odd_documents(spark, ("n_lines", "N_Dropped", "key")), 3, broadcast_bytes=limit)
    want = Counter((r[0], *x) for r, x in zip(ROWS, brute([r[1] for r in ROWS], 3), strict=True))
    assert Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == want
    assert sum(x[3] for x in want) > 0
    assert ld.dedup_lines(no_documents(spark), 3).count() == 0


def test_insert_then_delete_is_as_before(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, more = df.where("doc_id < 200"), df.where("doc_id >= 200")
    refs = ld.count_lines(first)
    both = ld.insert_documents(refs, more)
    assert set(both.collect()) == set(ld.count_lines(df).collect())
    assert set(ld.delete_documents(both, more).collect()) == set(refs.collect())


def test_filters_follow_the_counts(spark):
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = ld.count_lines(df.where("doc_id < 150"))
    after = ld.insert_documents(before, df.where("doc_id >= 150"))
    bits, _, _ = ld.build_filters(before, 10)
    n = 64
    def table(refs):
        hot = refs.where("n_docs >= 10").toPandas()
        return {s: sorted(g["k2"]) for s, g in hot.groupby((hot["k1"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(int))}

    def fresh(refs):
        import pandas as pd

        rows = []
        for s, keys in table(refs).items():
            one = ld.CuckooFilter(n)
            assert one.insert(np.array(keys))
            rows.append((int(s), one.table.tobytes()))
        return spark.createDataFrame(pd.DataFrame(rows, columns=["shard", "filter"]), "shard int, filter binary")

    changed = ld.update_filters(bits, n, fresh(before), before, after, 10)
    back = ld.update_filters(bits, n, changed, after, before, 10)
    for filters, refs in ((changed, after), (back, before)):
        got = {r.shard: np.frombuffer(r["filter"], np.uint16).copy() for r in filters.collect()}
        for s, keys in table(refs).items():
            one = ld.CuckooFilter(n, got[s])
            assert one.contains(np.array(keys)).all()
            assert int((one.table > 0).sum()) == len(keys)  # nothing left over from deleted keys


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**62, 2**62, 3000)
    f = ld.CuckooFilter(1024)
    assert f.insert(keys) and f.contains(keys).all()
    others = rng.integers(-2**62, 2**62, 20000)
    assert f.contains(others).mean() < 0.002
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01
    assert not ld.CuckooFilter(2).insert(keys)
    with pytest.raises(KeyError):
        ld.CuckooFilter(16).delete(keys[:1])


def test_query_digest(spark):

    r = ld.q_line_dedup(spark, "/root/testdata/sf0.001").first()
    assert len(r.kept_sha256) == len(hashlib.sha256(b"").hexdigest())


def test_deleted_and_inserted_again(spark):
    texts = random_texts()
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(4)
    got = {}
    for r in ld.without_and_again(df, F.col("doc_id") % 3 == 0, min_docs=10).collect():
        got.setdefault((r.state, r.doc_id), (r.n_lines, r.n_dropped))
    everything = [*enumerate(texts), (None, texts[0])]
    left = [(i, t) for i, t in everything if i is None or i % 3]
    for state, rows in (("again", everything), ("without", left)):
        want = {(state, i): (n, d) for (i, _), (_, n, d) in zip(rows, brute([t for _, t in rows], 10), strict=True)}
        assert {k: v for k, v in got.items() if k[0] == state} == want


def test_full_shard_has_the_filters_built_anew(spark):
    df = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(i % 7 * 300))) for i in range(70)], "doc_id long, text string")
    few, more = df.where("doc_id < 12"), df.where("doc_id >= 12")
    before = ld.count_lines(few)
    after = ld.insert_documents(before, more)
    bits, n_buckets, filters = ld.build_filters(before, 10)
    bits, grown, filters = ld.maintain(bits, n_buckets, filters, before, after, 10)
    assert grown > n_buckets
    hot = after.where("n_docs >= 10").select("k1", "k2")
    assert ld.probed(hot, bits, grown, filters, 10).count() == hot.count() > 500
    with pytest.raises(Exception, match="full"):
        ld.update_filters(bits, n_buckets, ld.build_filters(before, 10)[2], before, after, 10).collect()


def test_probes_of_a_shard_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ld, "LINES_PER_PROBE", 5)
    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in ld.dedup_lines(df, 10, broadcast_bytes=0).collect()}
    assert got == dict(enumerate(brute(texts, 10)))

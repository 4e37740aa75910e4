import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd import ROWS, no_documents, odd_documents
from pyspark.sql import functions as F
from replysift.llm import minhash_join as mj
from replysift.llm import settle
from replysift.llm.shingle_sets import Rule, linked, pairs_may_link, shingles, sketch
from test_partenum import brute, family, shingle_set


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("n", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_equals_all_pairs(spark, n, num, den):
    rng = random.Random(10 + n)
    texts = [t for size in (2, 4, 9, 30, 120, 400) for k in range(3) for t in family(rng, size, 9, max(1, size // 25))]
    texts += ["", "one", "One", " one\n"]
    rng.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, n, num, den)
    out = mj.near_duplicates(df, n, num, den)
    assert found(out) == want and 10 < len({c for _, _, c in want}) < len(rows) - 30
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(mj.q_minhash_near_dedup(spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85, 100)


def test_hot_group_in_small_blocks(spark, monkeypatch):
    """A large family whose members often miss the limit among themselves: many open groups."""
    monkeypatch.setattr(settle, "BLOCK", 16)
    monkeypatch.setattr(settle, "BLOCK_BYTES", 20_000)
    rng = random.Random(5)
    texts = list(family(rng, 120, 150, 8)) + [t for _ in range(20) for t in family(rng, 60, 2, 3)]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows, 3, 85, 100)
    assert found(mj.near_duplicates(df, 3, 85, 100)) == want
    assert 60 < len({c for _, _, c in want}) < 200


def test_all_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    for distance in (14, 21, 30):
        base = rng.integers(0, 256, (40, mj.VALUES)).astype(np.uint8)
        other = base.copy()
        for row in other:
            places = rng.permutation(mj.VALUES)[:distance]
            row[places] = rng.integers(0, 256, distance)
        a, b = mj.chunk_keys(base, distance), mj.chunk_keys(other, distance)
        assert all(set(x) & set(y) for x, y in zip(a, b, strict=True))
        assert len(set(a.ravel())) == a.size
        assert sum(bool(set(x) & set(y)) for x, y in itertools.combinations(a, 2)) == 0


def test_signatures_estimate_similarity():
    """Distances follow the binomial law the distance is chosen by."""
    rng = np.random.default_rng(2)
    for size in (20, 300):
        apart = []
        for _ in range(400):
            both = rng.integers(0, 2**63, size).astype(np.uint64)
            own = rng.integers(0, 2**63, (2, round(size * 0.15 / 0.85 / 2))).astype(np.uint64)
            a, b = (np.unique(np.concatenate((both, o))) for o in own)
            apart.append(int((mj.minhashes(a) != mj.minhashes(b)).sum()))
        p = (1 - size / (size + 2 * round(size * 0.15 / 0.85 / 2))) * 255 / 256
        assert abs(np.mean(apart) - 64 * p) < 0.6 and abs(np.var(apart) / (64 * p * (1 - p)) - 1) < 0.3
        assert max(apart) <= mj.distance_of(85, 100)


def test_long_sets_are_hashed_in_slices(monkeypatch):
    some = np.unique(np.random.default_rng(4).integers(0, 2**63, 10_000).astype(np.uint64))
    whole = mj.minhashes(some)
    monkeypatch.setattr(mj, "_SLICE", 77)
    assert (mj.minhashes(some) == whole).all()


def test_pairs_filter_never_drops_a_link():
    rng = random.Random(6)
    texts = [t for size in (3, 20, 130) for t in family(rng, size, 12, max(1, size // 10))]
    sets = [shingles(t.encode(), 3) for t in texts]
    rule = Rule(85, 100, mj.VALUES, mj.distance_of(85, 100))
    marks = [mj.minhashes(s).tobytes() + sketch(s) for s in sets]
    pairs = list(itertools.combinations(range(len(sets)), 2))
    a, b = ([p[k] for p in pairs] for k in (0, 1))
    may = pairs_may_link(np.array([len(sets[i]) for i in a]), [marks[i] for i in a], np.array([len(sets[i]) for i in b]), [marks[i] for i in b], rule)
    true = [linked(sets[i], sets[j], 85, 100) for i, j in pairs]
    assert all(m or not t for m, t in zip(may, true, strict=True)) and 0 < sum(true) <= may.sum() < len(pairs)


def test_odd_documents(spark):
    out = mj.near_duplicates(odd_documents(spark, ("node", "sig", "digest", "keys", "n_shingles", "component_id", "kept")), 3, 85, 100)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(out) == brute([(r[0], r[1]) for r in ROWS], 3, 85, 100)
    assert all(r.kept for r in out.where("doc_id is null").collect())
    assert mj.near_duplicates(no_documents(spark)).count() == 0 and mj.near_duplicates_removed(no_documents(spark)).count() == 0
    kept = mj.near_duplicates_removed(odd_documents(spark, ("kept", "__gone")))
    assert kept.columns[-2:] == ["kept", "__gone"] and kept.select(F.min("kept")).first()[0] == "own"
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 2 and 7 not in ids and ids[None] == 2


def test_same_groups_are_one(spark):
    rows = [(s, x) for s in (1, 2, 3) for x in (10, 11, 12)] + [(4, 10), (4, 11), (5, 10), (5, 11), (5, 12), (5, 13)]
    out = settle.distinct_groups(spark.createDataFrame(rows, "sig long, node long"))
    assert sorted(map(tuple, out.collect())) == [(1, 10), (1, 11), (1, 12), (4, 10), (4, 11), (5, 10), (5, 11), (5, 12), (5, 13)]
    assert shingle_set("A b", 3) == {("a", "b")}


def test_members_meet_their_payloads_once(spark):
    """Whatever the blocks, a member's payload is joined once, before its row is copied; blocks hold each pair once."""
    rows = [(1, x, 0 if x < 60 else 100 + x, 50) for x in range(100)] + [(2, x, x, 50) for x in range(3)]
    members = spark.createDataFrame(rows, "sig long, node long, label long, size long")
    payloads = spark.createDataFrame([(x, bytes(50)) for x in range(100)], "node long, sketch binary")
    dealt = settle._blocks(members, payloads, 16)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, \(node#\d+L = node#\d+L\)", plan)) == 1
    met = Counter()
    for (sig, _, _), some in itertools.groupby(sorted(dealt.collect(), key=lambda r: (r.sig, r.i, r.j)), key=lambda r: (r.sig, r.i, r.j)):
        some = list(some)
        assert len(some) <= 80
        met.update((sig, q.node, x.node) for q in some if q.query for x in some if not x.query)
    groups = {s: [r[1:3] for r in rows if r[0] == s] for s in (1, 2)}
    queries = {1: range(60, 100), 2: (0, 1)}  # of labels as common the greatest is the main one
    assert met == Counter((s, q, x) for s in groups for q in queries[s] for x, _ in groups[s])


def test_a_node_of_many_groups_meets_its_payload_once(spark):
    """The join's rows are nodes, not memberships: a node of 40 groups is one row of it."""
    rows = [(s, x, x, 50) for s in range(40) for x in range(12)]
    members = spark.createDataFrame(rows, "sig long, node long, label long, size long")
    payloads = spark.createDataFrame([(x, bytes(50)) for x in range(12)], "node long, sketch binary")

    def joined(made):
        """Rows of the joins by node, as the run counted them."""
        made.collect()
        plan, found, todo = made._jdf.queryExecution().executedPlan(), [], []
        todo.append(plan)
        while todo:
            node = todo.pop()
            name = node.getClass().getSimpleName()
            if name == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif name.endswith("QueryStageExec"):
                todo.append(node.plan())
            if "Join" in name and "node#" in node.leftKeys().toString():
                found.append(node.metrics().apply("numOutputRows").value())
            todo.extend(node.children().apply(k) for k in range(node.children().size()))
        return found

    assert joined(settle._blocks(members, payloads, 16)) == [12]
    sized = settle._sized(members.drop("size"), payloads, "sketch")
    assert joined(sized) == [12] and sorted(tuple(r) for r in sized.select("sig", "node", "label", "size").collect()) == rows


def test_rows_dealt_out_grow_with_a_group_not_with_its_square(spark):
    def rows_of(size):
        members = spark.range(size).selectExpr("1L AS sig", "id AS node", "id AS label", "50L AS size")
        payloads = spark.range(size).selectExpr("id AS node", "CAST('x' AS BINARY) AS sketch")
        return settle._blocks(members, payloads, 16).count()

    small, large = rows_of(400), rows_of(1600)
    assert large <= 2 * settle.SIDE * 1600 and large <= 4.1 * small


def test_groups_of_one_family_are_one(spark):
    """A family's nodes meet under 40 signatures, each of which a few of them miss; scattered groups of one component stay."""
    rows = [(s, x, 0 if x < 60 else x, 50) for s in range(40) for x in range(100) if (x + s) % 10]
    rows += [(1000 + s, x, label, 50) for s in range(30) for x, label in ((1000 + 2 * s, 1000), (1001 + 2 * s, 1000), (2000 + s, 2000 + s))]
    rows += [(2000, 3000, 3000, 50), (2000, 3001, 3001, 50), (2000, 3002, 3002, 50)]
    members = spark.createDataFrame(rows, "sig long, node long, label long, size long")
    out = settle.united_groups(members)
    assert out.columns == members.columns
    got = sorted(map(tuple, out.collect()))
    assert got == sorted({(0, *r[1:]) if r[0] < 40 else r for r in rows})


def test_united_groups_lose_no_pair(spark):
    rng = random.Random(8)
    label = {x: rng.choice([1, 1, 1, x]) for x in range(300)}
    of = {s: rng.sample(range(300), rng.choice([3, 9, 30])) if s % 3 else rng.sample(range(40), 35) for s in range(60)}
    rows = [(s, x, label[x], 50) for s, some in of.items() for x in some]
    members = spark.createDataFrame(rows, "sig long, node long, label long, size long")
    payloads = spark.createDataFrame([(x, bytes(50)) for x in range(300)], "node long, sketch binary")

    def pairs(made):
        cells = {}
        for r in settle._blocks(made, payloads, 16).collect():
            cells.setdefault((r.sig, r.i, r.j), ([], []))[r.query].append(r.node)
        return Counter(tuple(sorted((q, x))) for nodes, queries in cells.values() for q in queries for x in nodes if label[q] != label[x])

    before, after = pairs(members), pairs(settle.united_groups(members))
    assert set(before) <= set(after) and after.total() < before.total()

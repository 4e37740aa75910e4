import random
import re
from collections import Counter
from functools import partial

import numpy as np
import pytest
from odd import ROWS, no_documents, odd_documents
from replysift.llm import components as cc
from replysift.llm import partenum_join as pj
from replysift.llm import settle


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset({tuple(words)} if len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)})


def brute(rows, n, num, den):
    """(id, size, component) of each row by comparing all pairs; rows of one id are one document."""
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, a) in enumerate(known):
        for j, b in known[x + 1:]:
            if den * len(a & b) >= num * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def family(rng, size, members, change):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randint(0, change)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_equals_all_pairs(spark, n, num, den):
    rng = random.Random(n)
    texts = [t for size in (2, 4, 9, 30, 120, 400) for k in range(3) for t in family(rng, size, 9, max(1, size // 25))]
    texts += ["", "one", "One", " one\n"]
    rng.shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in pj.link_components(df, n, num, den).collect())
    want = brute(rows, n, num, den)
    assert got == want
    assert 10 < len({c for _, _, c in want}) < len(rows) - 30


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90, 100)
    assert Counter(tuple(r) for r in pj.q_partenum_join(spark, "/root/testdata/sf0.001").collect()) == want


def test_chain_of_copies_is_one_component(spark):
    """Neighbours link, ends don't: links of nodes that aren't the smallest must be found."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, order = [], list(range(40))
    rng.shuffle(order)
    for i in order:
        words[i * 5] = f"x{i}"
        rows.append((rng.randrange(10**6), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in pj.link_components(df, 3, 90, 100).collect())
    assert got == brute(rows, 3, 90, 100)


def test_linking_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        for _ in range(300):
            size = int(rng.integers(1, 300))
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            most = int(len(a) * (den - num) / den)
            gone = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**63, int(rng.integers(0, most + 1))).astype(np.uint64))))
            if len(b) and pj.linked(a, b, num, den) and not np.array_equal(a, b):
                assert set(pj.signatures(a, num, den)) & set(pj.signatures(b, num, den))


def test_blocks_find_every_link(spark):
    rng = random.Random(1)
    texts = list(family(rng, 60, 40, 2)) + list(family(rng, 60, 30, 4))
    sets = {pj.set_hash(s): s for s in (pj.shingles(t.encode(), 2) for t in texts)}
    nodes = sorted(sets)
    members = spark.createDataFrame([(1, x, x) for x in nodes], "sig long, node long, label long")
    stored = spark.createDataFrame([(x, sets[x].tobytes()) for x in nodes], "node long, shingles binary")
    links = pj.check_groups(members, stored, 80, 100, block=7)
    want = {(a, b) for a in nodes for b in nodes if a < b and pj.linked(sets[a], sets[b], 80, 100)}
    label = {r.node: r.label for r in cc.components(links).collect()}
    true = {r.node: r.label for r in cc.components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    assert label == true and all(tuple(sorted(r)) in want for r in links.collect())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    out = pj.link_components(odd_documents(spark, ("node", "sig", "n_shingles", "component_id")), 3, 90, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute([(r[0], r[1]) for r in ROWS], 3, 90, 100)
    assert pj.link_components(no_documents(spark)).count() == 0
    kept = pj.one_of_each(odd_documents(spark, ("component_id",)))
    assert kept.columns[-1] == "component_id"
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 1 and 7 not in ids and ids[None] == 2 and ids[11] == ids[12] == ids[13] == ids[14] == 1
    assert pj.one_of_each(no_documents(spark)).count() == 0


def test_sketches_never_drop_a_link():
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        dropped = 0
        for _ in range(300):
            a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64))
            b = np.unique(np.concatenate((rng.permutation(a)[int(rng.integers(0, len(a) // 3 + 1)):], rng.integers(0, 2**63, int(rng.integers(0, 60))).astype(np.uint64))))
            if len(b):
                may = pj.may_link(len(a), pj.sketch(a), len(b), pj.sketch(b), num, den)
                assert may or not pj.linked(a, b, num, den)
                assert pj.differing_bits(pj.sketch(a), pj.sketch(b)) <= len(np.setxor1d(a, b))
                dropped += not may
        assert dropped > 20


def test_signatures_with_the_same_rows_go_on_as_one(spark):
    """Of the signatures that two texts share one moves on; rows that come twice don't cancel out."""
    shared = {s: (1, 2) for s in range(100, 300)} | {300: (1, 2, 3), 301: (1, 2, 3), 302: (2, 2, 3, 3), 303: (2, 3), 304: (1, 1, 2, 4), 305: (1, 3, 3, 4)}
    alone = {400: (5,), 401: (5, 5), 402: (None, 5)}
    rows = [(s, x) for s, some in (shared | alone).items() for x in some] + [(None, 1), (None, 2)]
    out = settle.candidate_groups(spark.createDataFrame(rows, "sig long, node long").repartition(6))
    assert sorted(map(tuple, out.collect())) == sorted((s, x) for s in (100, 300, 302, 303, 304, 305) for x in shared[s])


def test_candidates_move_on_with_the_texts_not_their_signatures(spark):
    rng = random.Random(21)
    bases = [next(family(rng, 300, 1, 0)) for _ in range(30)]
    texts = [t for base in bases for t in (base, base + " end")]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    keys = settle.keys_from_texts(5, partial(pj.signatures, num=80, den=100))(df, None)
    shared = settle.candidate_groups(keys)
    assert keys.count() > 10_000 and 60 <= shared.count() <= 4 * len(texts)
    assert shared.select("node").distinct().count() == len(texts)


def test_documents_that_stay_do_not_move(spark):
    """One of each is told by the ids that go; an id stays with any of its rows."""
    rng = random.Random(31)
    texts = [t for _ in range(200) for t in family(rng, 30, 1, 0)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, texts[3]), (1001, texts[4]), (1001, ""), (1002, "once"), (1002, None), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1500")  # fewer than the ids that stay take
        out = pj.one_of_each(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("LeftAnti")[0]
    assert Counter(map(tuple, out.collect())) == Counter([r for r in rows if r[0] not in (1000, 1001, 1002)] + [(1001, ""), (1002, None)])

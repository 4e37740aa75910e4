import hashlib
import random
import re
from collections import Counter

import pytest
from odd import ROWS, no_documents, odd_documents
from pyspark.sql import functions as F
from replysift.llm import winnow as wn

UNIT = re.compile(r"[^\x20\x09-\x0D]{1,%d}" % wn.UNIT_CHARS)


def selected_grams(text, k, window):
    """Winnowing on the gram texts themselves is not possible (hashes decide), so the hashes
    come from Spark for each distinct gram; this gives the grams to hash."""
    units = UNIT.findall(text)
    n = max(len(units) - k + 1, min(len(units), 1))
    return [tuple(units[i:i + k]) for i in range(n)]


def brute(spark, texts, k, window):
    grams = {g for t in texts for g in selected_grams(t, k, window)}
    rows = [(list(g), i) for i, g in enumerate(grams)]
    df = spark.createDataFrame(rows, "g array<string>, i long")
    unit = F.transform("g", lambda u: F.xxhash64(u))
    h = F.shiftright(F.xxhash64(*[F.get(unit, F.lit(j)) for j in range(k)]), 28)
    value = {tuple(r.g): r.h for r in df.select("g", h.alias("h")).collect()}
    out = []
    for t in texts:
        hashes = [value[g] for g in selected_grams(t, k, window)]
        picks = set()
        for i in range(max(len(hashes) - window + 1, min(len(hashes), 1))):
            part = hashes[i:i + window]
            least = min(part)
            picks.add((i + max(j for j, x in enumerate(part) if x == least), least))
        out.append(sorted(picks))
    return out


@pytest.mark.parametrize(("k", "window"), [(4, 4), (2, 8), (1, 1)])
def test_equals_winnowing_by_hand(spark, k, window):
    rng = random.Random(k)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", " ", "a" * 50, "a a a a a a a a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: sorted((x.position, x.hash) for x in r.fingerprint) for r in wn.fingerprints(df, k=k, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(spark, texts, k, window)


def test_shared_run_is_always_found(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        run = " ".join(f"s{rng.randrange(10**6)}" for _ in range(wn.K + wn.WINDOW - 1))
        a, b = (" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))) for _ in range(2))
        rows.append((i, f"{a} {run} {b}", f"{b[::-1]} {run}"))
    df = spark.createDataFrame(rows, "i long, x string, y string")
    both = wn.selected(wn.selected(df, "x", "fx"), "y", "fy")
    assert both.where(wn.likeness(wn.hashes(F.col("fx")), wn.hashes(F.col("fy"))) == 0).count() == 0
    short = wn.selected(df.select(F.expr("'a b c x'").alias("x"), F.expr("'a b c y'").alias("y")), "x", "fx")
    assert wn.selected(short, "y", "fy").where(wn.likeness(wn.hashes(F.col("fx")), wn.hashes(F.col("fy"))) > 0).count() == 0


def edited(rows):
    """The edited texts of (id, text) rows, by the rule."""
    known = sorted([(i, (t or "").encode()) for i, t in rows if i is not None])
    out = Counter()
    for at, (i, t) in enumerate(known):
        t, after = t.decode(), known[(at + 1) % len(known)][1].decode()
        half = len(t) // 2
        out[i, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    for i, t in rows:
        if i is None:
            t = t or ""
            out[None, len(t), hashlib.sha256(t[:len(t) - len(t) // 2].encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_edited_texts(spark, buckets):
    out = wn.edit_and_compare(odd_documents(spark, ("__b", "fingerprint")), n_buckets=buckets)
    got = Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in out.collect())
    assert got == edited([(r[0], r[1]) for r in ROWS])


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = wn.q_winnow(spark, sf).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == edited([(d.doc_id, d.text) for d in docs])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    text = {d.doc_id: d.text for d in docs}
    by_text = {}
    for r in rows:
        by_text.setdefault(text[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len(by_text) < len(rows)
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited > 0.15 for r in long) > 0.97 * len(long)
    plain = wn.q_winnow(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plain and "Pandas" not in plain and "Arrow" not in plain


def test_few_and_no_documents(spark):
    one = spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")
    r = wn.edit_and_compare(one).first()
    assert r.edited == "a b c d " + "a b c d" and r.near_next == 1.0
    assert wn.edit_and_compare(no_documents(spark)).count() == 0
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {(r.fingerprint, r.near_edited, r.near_next) for r in wn.edit_and_compare(empty).collect()} == {("", 1.0, 1.0)}

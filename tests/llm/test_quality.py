import re
from collections import Counter

import numpy as np
from odd import ROWS, no_documents, odd_documents
from pyspark.sql import functions as F
from replysift.llm import gbt_quality as gq
from replysift.llm import quality_rules as qr
from replysift.llm.text_stats import longest_run, repeated_words, word_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n)


def figures(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_figures_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in qr.judge_documents(docs).collect()}
    for d in docs.collect():
        assert figures(got[d.doc_id]) == brute(d.text)
        assert not (got[d.doc_id].kept and got[d.doc_id].base_failed)


def test_rules_on_odd_documents(spark):
    out = qr.judge_documents(odd_documents(spark, ("kept", "Clean_Text"))).collect()
    assert Counter((r.doc_id, *figures(r)) for r in out) == Counter((r[0], *brute(r[1])) for r in ROWS)
    assert qr.judge_documents(no_documents(spark)).count() == 0


def test_lines():
    verdict = {
        "Home | About | Contact | Login": "navigation", "Products > Chairs > Oak": "navigation",
        "We use cookies to improve this site.": "boilerplate", "Lorem ipsum dolor sit amet, and so on for long.": "boilerplate",
        "buy buy buy buy buy buy buy now buy": "boilerplate", "THIS!! IS!! NOT!! A!! SENTENCE!!": "punctuation",
        "a$$$ b%%% c&&& d### e***": "punctuation", "---- 12 ----": "punctuation", "Short title": "punctuation", "": None,
        "A plain sentence about the weather in autumn.": None, "Yes, he said.": None,
        "A long line of prose that has no end mark but goes on well beyond a title": None,
    }
    assert {x: qr.failing(x.encode()) for x in verdict} == verdict


def test_document_loses_too_much():
    good = "\n".join(" ".join(f"{w}{i}" for w in "this sentence tells another small story of its own".split()) + "." for i in range(10))
    bad = "\n".join("Home | About | Contact | Help | Shop | More" for _ in range(1))
    judge = qr.Rules(50, 0.5, 0.3).judge
    assert judge(good.encode())[-1] and judge((good + "\n" + bad).encode())[-1]
    assert judge((good + "\n" + bad).encode())[0] == good.encode()
    worse = "\n".join(f"Home{i} | About{i} | Contact{i} | Help{i} | Shop{i} | M{i}" for i in range(10))
    assert not judge((good + "\n" + worse).encode())[-1]


def test_counting_helpers():
    assert repeated_words(word_ids(b"a b c x a b c".split())) == 6
    assert repeated_words(word_ids(b"a a a a".split())) == 4 and repeated_words(word_ids(b"a b".split())) == 0
    assert longest_run(word_ids(b"a b b b c".split())) == 3 and longest_run(word_ids([])) == 0


def test_flat_walk_equals_a_walk_by_hand():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = gq.fit_trees(x, y, trees=30)

    def by_hand(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return total

    assert np.allclose(model.margin(x), [by_hand(r) for r in x])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(gq.fit_trees(x, y, trees=30).margin(x), model.margin(x))


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = gq.q_gbt_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    right = (rows["predicted"] == rows["quality"])
    assert len(rows) > 40 and right.mean() > 0.93
    assert rows["score"].between(0, 1).all()


def test_classifier_on_odd_documents(spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (9, 1, 0), (11, 0, 0), (15, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = odd_documents(spark, ("score", "x", "y"))
    model = gq.fit_quality(docs, labels, F.col("doc_id").isNotNull())
    out = gq.score_quality(docs, model).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    nothing = gq.fit_quality(no_documents(spark), labels, F.lit(True))
    assert {r.score for r in gq.score_quality(docs, nothing).collect()} == {0.5}
    assert gq.score_quality(no_documents(spark), model).count() == 0

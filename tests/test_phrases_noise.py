"""Categories as tables equal the regex scorer; learned transitions tell noise from prose."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import listing
from replysift.config import CueRule, DEFAULT_RULES, RuleSet
from replysift.functions.noise import SYMBOLS, learn_transitions
from replysift.functions.phrases import grams, rule_tables, table_scores
from replysift.operators.classify import classify, classify_by_table, validate
from replysift.sources.listing import with_row_key

TEXTS = ["done", "not corrected yet", "not  corrected", "Don’t know — how do I?", "pain_killer pain", "which one? which one?", "no access to that page",
         "can't", "cannot be added, added", "nothing was changed", "unclear unclear. Help!", "", None, "12", "?", "???", "édone done", "won't save-won't save",
         "to be done", "not", "been not been done", "a", "dose reduced reduced dose", "BLOOD PRESSURE", "blood\npressure", "not yet updated or updated"]


def random_texts(n):
    rng = random.Random(3)
    words = [w for p in DEFAULT_RULES.phrases for w in p.split()] + ["x", "?", "-", "'", "_", "the"]
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", "?", "_", "\n"]) for _ in range(rng.randint(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("rules", [DEFAULT_RULES, RuleSet((CueRule("A", ("a b", "b", "c d e")), CueRule("B", ("b c", "a b c", "e"), question_mark=True),
                                                           CueRule("C", ("d",), overriding=True)), default_label="none", neutral=("a b c d",))])
def test_equals_the_regex_scorer(spark, rules):
    rng = random.Random(5)
    letters = [" ".join(rng.choice("abcdefx") for _ in range(rng.randint(1, 14))) for _ in range(200)]
    df = with_row_key(listing(spark, TEXTS + random_texts(300) + letters), id_col="Query ID")
    phrases, categories = rule_tables(spark, rules)
    want = classify(df, rules=rules)
    got = classify_by_table(df, phrases, categories, default_label=rules.default_label)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_very_many_phrases(spark):
    """Phrases stay a table: 20,000 of them, of which few occur."""
    phrases = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("phrase"))
    categories = spark.createDataFrame([("even", 1, False, False), ("odd", 0, False, False)], "label string, priority int, overriding boolean, question_mark boolean")
    texts = spark.createDataFrame([(1, "item 4 and item 6, item 7"), (2, "item 77777"), (3, "ITEM 9 item 9"), (4, None)], "k long, t string")
    got = {r.k: (r.label, r.reasoning) for r in table_scores(texts, "k", "t", phrases, categories, "rest").collect()}
    assert got == {1: ("even", "cues: odd 1, even 2"), 2: ("rest", "cues: odd 0, even 0"), 3: ("odd", "cues: odd 2, even 0"), 4: ("rest", "cues: odd 0, even 0")}


@pytest.mark.parametrize("small", [True, False])
def test_small_tables_go_to_the_texts(spark, monkeypatch, small):
    """Grams never move for a table that fits a broadcast, whatever Spark thinks of its size; beyond it both move."""
    from replysift.functions import phrases as ph

    if not small:
        monkeypatch.setattr(ph, "BROADCAST_BYTES", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, categories = rule_tables(spark, RuleSet((CueRule("A", ("a b", "b")), CueRule("B", ("b c",))), default_label="none"))
        texts = spark.createDataFrame([(1, "a b c"), (2, "b c b"), (3, "x"), (4, None)], "k long, t string")
        out = table_scores(texts, "k", "t", table, categories, "none")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == small
        assert {r.k: r.reasoning for r in out.collect()} == {1: "cues: A 1, B 0", 2: "cues: A 1, B 1", 3: "cues: A 0, B 0", 4: "cues: A 0, B 0"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("bad", [("A", "two  "), ("A", None), ("A", "why?"), ("B", "shared")])
def test_unusable_phrases_fail(spark, bad):
    phrases = spark.createDataFrame([("A", "shared"), bad], "label string, phrase string")
    categories = spark.createDataFrame([("A", 0, False, False), ("B", 1, False, False)], "label string, priority int, overriding boolean, question_mark boolean")
    with pytest.raises(Exception, match="phrase"):
        table_scores(spark.createDataFrame([(1, "shared")], "k long, t string"), "k", "t", phrases, categories, "rest").collect()


def test_grams(spark):
    df = spark.createDataFrame([("a b_2, c",), ("--",), ("",), (None,), ("-x",)], "t string").withColumn("g", grams(F.col("t"), 2))
    got = [None if r.g is None else [tuple(x) for x in r.g] for r in df.collect()]
    assert got[0] == [(0, 1, "a"), (0, 2, "a b_2"), (1, 1, "b_2"), (1, 2, "b_2, c"), (2, 1, "c")]
    assert got[1] == [] and not got[2] and not got[3] and got[4] == [(0, 1, "x")]


def reduced(text):
    out = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return " ".join("".join(c if "a" <= c <= "z" or c == " " else "~" for c in out).split())


def test_transitions_equal_plain_counting(spark):
    texts = ["The quick brown fox.", "Übung macht  den Meister!", "", None, "a", "42", "naïve été", "the end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    learned = learn_transitions(df, "t")
    pairs = Counter(s[i:i + 2] for s in map(reduced, texts) for i in range(len(s) - 1))
    first = Counter()
    for p, n in pairs.items():
        first[p[0]] += n
    weight = {a + b: math.floor(1000 * math.log((pairs[a + b] + 1) / (first[a] + 28)) + 0.5) for a in SYMBOLS for b in SYMBOLS}
    assert learned.weights == tuple(weight[a + b] for a in SYMBOLS for b in SYMBOLS)
    got = {r.t: (r.s.pairs, r.s.total) for r in df.withColumn("s", learned.score("t")).collect()}
    assert got == {t: (max(len(reduced(t)) - 1, 0), sum(weight[reduced(t)[i:i + 2]] for i in range(len(reduced(t)) - 1))) for t in texts}


def test_stretches_equal_plain_counting(monkeypatch):
    """Texts cut across stretches, empty ones between, and arrays that begin inside a larger one."""
    import numpy as np
    import pyarrow as pa
    from replysift.functions import noise

    rng = random.Random(8)
    texts = ["", "a", "", *["".join(rng.choice(SYMBOLS) for _ in range(rng.choice([0, 0, 1, 2, 3, 9, 40]))) for _ in range(200)], ""]
    weights = np.arange(784) ** 2 - 90_000
    number = {c: i for i, c in enumerate(SYMBOLS)}
    for stretch in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(noise, "_STRETCH", stretch)
        for cut in (0, 3, 50, len(texts), len(texts) - 1):
            some = texts[cut:]
            pairs = [[28 * number[a] + number[b] for a, b in zip(t, t[1:])] for t in some]
            column = pa.array(texts, pa.string()).slice(cut)
            n, total = noise.sum_pairs(column, weights)
            assert n.tolist() == [len(p) for p in pairs] and total.tolist() == [int(sum(weights[i] for i in p)) for p in pairs]
            counts = Counter(i for p in pairs for i in p)
            assert noise.count_pairs(column).tolist() == [counts[i] for i in range(784)]


def test_no_character_becomes_a_row(spark):
    """Learning moves a count for each kind of transition and task, and a text is scored once."""
    df = spark.createDataFrame([("the end of the road",), ("xq zk",)], "t string")
    learned = learn_transitions(df, "t")
    plan = df.select(learned.score("t").alias("s"), learned.is_noise("t").alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_replace") <= 3 and "transform" not in plan


def test_planted_noise_is_found(spark):
    from replysift.plans.queries import QUERIES

    rows = QUERIES["noise_documents"](spark, "/root/testdata/sf0.01").collect()
    planted = [r for r in rows if r.planted]
    others = [r for r in rows if not r.planted and r.pairs >= 40]
    assert len(planted) > 100 and sum(r.noise for r in planted) >= 0.95 * len(planted)
    assert sum(r.noise for r in others) <= 0.01 * len(others)


def test_validate_by_learned_transitions(spark):
    df = listing(spark, ["the value was corrected and saved on the page", "xqzjkvw qxzzkj vwqxzj kkvqx", "ok", None])
    learned = learn_transitions(listing(spark, ["the value was corrected and saved", "no access to that page since monday", "please clarify which one is meant here"] * 40), "Site Response")
    assert [r.Is_Valid for r in validate(df, reject_gibberish=learned).orderBy("Query ID").collect()] == [True, False, True, False]

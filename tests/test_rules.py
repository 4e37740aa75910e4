"""M11(a): the rule scorer: labels on own phrase lists, one-pass == per-category counts."""

import random

from pyspark.sql import functions as F

from replysift.config import CueRule, RuleSet
from replysift.functions.rules import rule_score_struct
from fake_model import rule_result

# Own phrases, one list per expected category.
AFFIRMATIVE = ["Onset time amended.", "height added, page saved", "REMOVED", "all three resolved",
               "Entry for March deleted", "revised by the night team"]
CONFUSED = ["How should we count half days?", "no access since the upgrade", "menu is greyed out",
            "please advise", "it won't save", "what does code 12 stand for", "we don\u2019t see that form"]
MEDICAL = ["vomiting overnight", "infection of the left ear", "allergy since birth", "chronic back pain",
           "physician was called in", "therapy goes on"]
MISC = ["paper copy is in the binder", "answer comes on Friday", "TBC", "n.a.", "?!"[1:], "line 4"]
DENIED = ["not corrected yet", "Nothing was changed", "page isn't saved", "value never entered", "to be revised"]


def labels(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(rule_score_struct(F.col("t"))["label"]).collect()]


def test_category_phrases(spark):
    assert labels(spark, AFFIRMATIVE) == ["Affirmative"] * len(AFFIRMATIVE)
    assert labels(spark, CONFUSED) == ["Confused"] * len(CONFUSED)
    assert labels(spark, MEDICAL) == ["Medically Related"] * len(MEDICAL)
    assert labels(spark, MISC) == ["Miscellaneous"] * len(MISC)
    assert labels(spark, DENIED) == ["Miscellaneous"] * len(DENIED)


def test_priority_and_confidence(spark):
    texts = ["updated, but is it clinical?", "symptom updated", "surgery done, form updated",
             "nothing here", "Don’t understand", "édone", "done_x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(rule_score_struct(F.col("t"))).collect()]
    assert got[0][0] == "Confused"
    assert got[1][0] == "Medically Related"          # m = a -> medical wins the tie
    assert got[2][0] == "Affirmative"                # a > m
    assert got[3][:2] == ("Miscellaneous", 0.5)
    assert got[4][0] == "Confused"                   # typographic apostrophe folded
    assert got[5][0] == "Affirmative"                # non-ASCII letter is not a word character
    assert got[6][0] == "Miscellaneous"              # '_' is a word character
    assert abs(got[1][1] - (0.3 + 0.65 * 1 / 2)) < 1e-12


def test_spark_equals_plain_python_on_random_texts(spark):
    rng = random.Random(3)
    words = ["done", "updated", "patient", "clinical", "clinically", "can't", "cannot", "?", "dose", "reduced",
             "not", "sure", "yet", "never", "nothing", "was", "x", "é", "_", "Done", "UPDATED", "don’t", "understand",
             ",", ".", "\n", "surgery", "locked", "symptom", "symptoms", "blood", "pressure", "error", "message"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(rule_score_struct(F.col("t"))).collect()]
    exp = [rule_result(t) for t in texts]
    assert got == exp


def test_custom_rule_set(spark):
    rules = RuleSet(rules=(CueRule("Urgent", ("asap", "urgent"), overriding=True),
                           CueRule("Thanks", ("thank you", "thanks"))), default_label="Other")
    df = spark.createDataFrame([("thanks, urgent",), ("thank you",), ("hello",)], "t string")
    got = [r[0] for r in df.select(rule_score_struct(F.col("t"), rules)["label"]).collect()]
    assert got == ["Urgent", "Thanks", "Other"]


def test_rule_set_checks():
    import pytest

    with pytest.raises(ValueError):
        RuleSet(rules=(CueRule("A", ("x",)), CueRule("A", ("y",))))
    with pytest.raises(ValueError):
        RuleSet(rules=(CueRule("A", ()),))
    with pytest.raises(ValueError):
        RuleSet(rules=(CueRule("A", ("x",)),), neutral=("x",))


def test_phrases_may_share_words(spark):
    rules = RuleSet((CueRule("Open", ("not done",)), CueRule("Closed", ("done",))), default_label="Rest")
    df = spark.createDataFrame([("not done",), ("done",), ("done, not done, done",), ("not yet",)], "t string")
    got = [r[0] for r in df.select(rule_score_struct(F.col("t"), rules)["label"]).collect()]
    assert got == ["Open", "Closed", "Closed", "Rest"]

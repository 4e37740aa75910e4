"""The validity rule, as a native expression, against a plain statement of it."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from replysift.functions.validity import is_valid_response, looks_like_gibberish


BLANK_CATEGORIES = {"Zs", "Zl", "Zp"}
BLANK_CONTROLS = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85")


def says_something(answer) -> bool:
    """The rule by Unicode categories: between its outer blanks an answer holds something
    other than digits, full stops and hyphens, and isn't a word for "no value". Full
    stops and hyphens alone do say something."""
    inner = list(answer or "")
    for end in (0, -1):
        while inner and (inner[end] in BLANK_CONTROLS or unicodedata.category(inner[end]) in BLANK_CATEGORIES):
            inner.pop(end)
    if not inner or "".join(inner).lower() in {"nan", "none", "null", "na"}:
        return False
    kinds = {"mark" if c in ".-" else "digit" if unicodedata.digit(c, None) is not None else "other" for c in inner}
    return "other" in kinds or "digit" not in kinds


CASES = [
    (None, False), ("", False), ("   ", False), (" 　", False), ("\t\n", False),
    ("nan", False), ("NaN", False), (" None ", False), ("null", False), ("NA", False), ("na ", False),
    ("12.5", False), ("2025-03-17", False), ("--12..", False), ("²", False), ("٣", False),
    ("42\n", False), ("007", False),
    (".", True), ("-", True), ("ok", True), ("1/2/2025", True), ("+5", True), ("1,000", True),
    ("50%", True), ("1e5", True), ("n/a", True), ("N/A", True), ("done", True),
    ("line one\nline two", True), ('said ""yes""', True), ("nanx", True),
]


def test_cases(spark):
    df = spark.createDataFrame([(v,) for v, _ in CASES], "r string")
    got = [r[0] for r in df.select(is_valid_response(F.col("r"))).collect()]
    assert got == [e for _, e in CASES]


def test_random_strings_match_plain_rule(spark):
    rng = random.Random(5)
    pool = list("0123456789.- \t\nabnNoOeEuUlL,+/%") + [" ", " ", "٣", "²", "①", "　",
                                                       " ", "\u0085", "½", "⅕"]
    values = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    values += ["nan", " none", "NULL ", "na", "N/A", "١٢", "⁰-¹"]
    df = spark.createDataFrame([(v,) for v in values], "r string")
    got = [r[0] for r in df.select(is_valid_response(F.col("r"))).collect()]
    expected = [says_something(v) for v in values]
    bad = [(v, g, e) for v, g, e in zip(values, got, expected) if g != e]
    assert not bad, bad[:10]


@pytest.mark.parametrize("text,expected", [("xkcdqwrtzplmn xx", True), ("1234 !!", True), ("hello there", False)])
def test_gibberish_option(spark, text, expected):
    df = spark.createDataFrame([(text,)], "r string")
    assert df.select(looks_like_gibberish(F.col("r"))).first()[0] is expected


def test_property_random_unicode(spark):
    """Property check over generated text (hypothesis), same plain rule."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.one_of(st.none(), st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=8),
                     st.from_regex(r"\A[ \t0-9.\-]{0,6}\Z")))
    def collect(v):
        seen.append(v)

    collect()
    df = spark.createDataFrame([(v,) for v in seen], "r string")
    got = [r[0] for r in df.select(is_valid_response(F.col("r"))).collect()]
    bad = [(v, g) for v, g in zip(seen, got) if g != says_something(v) and "\x00" not in (v or "")]
    assert not bad, bad[:10]

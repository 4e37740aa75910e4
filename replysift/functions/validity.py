"""Is an answer meaningful enough to classify? A native Column expression.

Rules, in order: null or empty is invalid; after a Unicode trim and lower-casing,
one of the empty words is invalid; with every ``.`` and ``-`` removed, a non-empty
run of digits only is invalid; anything else is valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EMPTY_WORDS
from .text import DG_CLASS, WS_CLASS, col_of, unicode_trim


def normalised_answer(c: Column | str) -> Column:
    return F.lower(unicode_trim(c))


def _empty_word_pattern() -> str:
    words = sorted((w for w in EMPTY_WORDS if w), key=lambda w: (-len(w), w))
    # ASCII case-insensitive equals lower-casing here: no non-ASCII character
    # lower-cases to a letter of these words.
    return f"\\A[{WS_CLASS}]*+(?i:{'|'.join(words)})?[{WS_CLASS}]*+\\z"


# Blank, or an empty word between blanks.
EMPTY_ANSWER_PATTERN = _empty_word_pattern()
# Blanks, then only digits, dots and hyphens with at least one digit, then blanks.
DIGITS_ANSWER_PATTERN = (
    f"\\A[{WS_CLASS}]*+[.\\-]*+[{DG_CLASS}][{DG_CLASS}.\\-]*+[{WS_CLASS}]*+\\z"
)


def is_valid_response(c: Column | str) -> Column:
    """The rule as two anchored patterns on the raw text. Equivalent to trimming,
    lower-casing and testing the result, but without copying or rescanning a
    long text: both patterns stop at the first character that cannot match."""
    c = col_of(c)
    return F.coalesce(~c.rlike(EMPTY_ANSWER_PATTERN) & ~c.rlike(DIGITS_ANSWER_PATTERN), F.lit(False))


def looks_like_gibberish(c: Column | str, min_token: int = 12) -> Column:
    """D3 (off by default): no letter at all, or a long token without a vowel."""
    t = normalised_answer(col_of(c))
    no_letter = ~t.rlike("\\p{L}")
    vowel_free_run = t.rlike(f"(?<![\\p{{L}}])[b-df-hj-np-tv-xz]{{{min_token},}}(?![\\p{{L}}])")
    return F.coalesce(no_letter | vowel_free_run, F.lit(False))

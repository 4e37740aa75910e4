"""Text helpers built from Spark column expressions (JVM-side, codegen-friendly).

The character classes are written with the characters themselves so that the
same class text can be handed to Java regex (Spark) and RE2 (the SQL oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NA_TOKENS

# Characters the original validator strips as white space
# (Python ``str.strip()`` semantics), written as a regex character-class body.
WS_CLASS = (
    "\t-\r"
    "\x1c- "
    "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Characters Python's ``str.isdigit()`` accepts inside the Basic
# Multilingual Plane: all decimal digits plus the other digit-type numbers.
DG_CLASS = (
    "\\p{Nd}"
    "\u00b2\u00b3\u00b9\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089"
    "\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff"
    "\u2776-\u277e\u2780-\u2788\u278a-\u2792"
)

# ``\A`` and ``\z`` rather than ``^``/``$``: Java's ``$`` also matches before a
# final line break. Possessive quantifiers and the look-behind keep every
# pattern linear on long texts (a trailing-blank search that may start inside a
# run of blanks is quadratic in the run length).
TRIM_PATTERN = f"\\A[{WS_CLASS}]++|(?<![{WS_CLASS}])[{WS_CLASS}]++\\z"
ALL_DIGITS_PATTERN = f"\\A[{DG_CLASS}]+\\z"


def named(name: str) -> Column:
    """Column by its exact name: dots and backticks belong to the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def col_of(c: Column | str) -> Column:
    return named(c) if isinstance(c, str) else c


def unicode_trim(c: Column | str) -> Column:
    """Strip leading and trailing Unicode white space (``F.trim`` only strips U+0020)."""
    return F.regexp_replace(col_of(c), TRIM_PATTERN, "")


def null_if_token(c: Column | str, tokens=NA_TOKENS) -> Column:
    """Null when the raw (untrimmed, case-sensitive) value is one of ``tokens``."""
    c = col_of(c)
    if not tokens:
        return c
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def category_slug(c: Column | str) -> Column:
    """File-name slug of a category: lower case, blanks to underscores."""
    return F.regexp_replace(F.lower(col_of(c)), " ", "_")


def preview(c: Column | str, n: int) -> Column:
    """First ``n`` characters of the text form of a value (display only)."""
    return F.substring(col_of(c).cast("string"), 1, n)


def model_text(c: Column | str | None) -> Column:
    """Text handed to a model: missing value -> ``"nan"``, absent column -> ``""``."""
    if c is None:
        return F.lit("")
    return F.coalesce(col_of(c).cast("string"), F.lit("nan"))

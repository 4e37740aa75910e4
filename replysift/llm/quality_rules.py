"""Quality rules (7), line first: bad lines go, then documents that lost too much.

Every line with a word is tested by itself:

* navigation: menu separators (``|``, ``>``, ``»``, ``•``, ``·``) make up a
  good part of its tokens;
* punctuation: symbols instead of prose (many ``#*$%&|<>`` for its length), hardly any letters, shouted
  throughout in capitals or with ``!!`` after most words, or a short fragment
  without an end mark;
* boilerplate: a short line with a phrase of web furniture, a placeholder text,
  or one word said over and over.

Lines that fail are removed. A document is rejected if its base figures fail
(too few words, or too many words in repeated three-word windows) or if the
removed lines hold more than ``max_lost`` of its words.

Defined cases: a null or empty text has no words and fails; blank lines are
neither tested nor counted as lost and stay; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts
from .text_stats import SYMBOL_BYTES, byte_counts, code_points, repeated_lines, repeated_words, word_ids

MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_LOST = 0.3
#: A fragment without an end mark has fewer words than this.
FRAGMENT_WORDS = 4
SEPARATORS = frozenset(x.encode() for x in "| > » › • · / -".split())
END_MARKS = tuple(x.encode() for x in ". ! ? … : ; , \" ' ” ’ » ) ]".split())
FURNITURE = re.compile(
    rb"(?i)cookie|javascript|all rights reserved|terms of (?:use|service)|privacy policy|click here|"
    rb"sign (?:in|up)|log ?in|subscribe|newsletter|skip to content|back to top|share this|read more")
PLACEHOLDER = b"lorem ipsum"


def is_navigation(words: list[bytes], distinct: set[bytes]) -> bool:
    if distinct.isdisjoint(SEPARATORS):
        return False
    marks = sum(w in SEPARATORS for w in words)
    return marks >= 2 and marks >= 0.2 * len(words)


def is_badly_punctuated(line: bytes, words: list[bytes]) -> bool:
    counts = byte_counts(line)
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    letters = capitals + small + int(counts[128:].sum())
    dense = sum(map(len, words))
    symbols = int(counts[SYMBOL_BYTES].sum())
    if symbols > 3 and symbols > 0.1 * dense or letters < 0.5 * dense:
        return True
    if len(words) >= 5:
        if counts[33] > len(words) and sum(w.endswith(b"!!") for w in words) > 0.5 * len(words):
            return True
        return capitals >= 20 and capitals > 4 * small
    return len(words) < FRAGMENT_WORDS and not words[-1].endswith(END_MARKS)


def is_boilerplate(line: bytes, words: list[bytes], distinct: set[bytes]) -> bool:
    if len(words) <= 20 and FURNITURE.search(line) or PLACEHOLDER in line.lower():
        return True
    n = len(words)
    return n >= 8 and len(distinct) <= n // 2 + 1 and max(Counter(words).values()) > 0.5 * n


def failing(line: bytes) -> str | None:
    """Name of the rule a line fails; None if it may stay."""
    words = line.split()
    if not words:
        return None
    distinct = set(words)
    if is_navigation(words, distinct):
        return "navigation"
    if is_boilerplate(line, words, distinct):
        return "boilerplate"
    return "punctuation" if is_badly_punctuated(line, words) else None


class Rules:
    def __init__(self, min_words: int, max_repeated: float, max_lost: float):
        self.min_words, self.max_repeated, self.max_lost = min_words, max_repeated, max_lost

    def __call__(self, texts):
        rows = [self.judge(t) for t in texts]
        columns = list(zip(*rows, strict=True)) or [()] * 10
        kinds = [pa.string(), *[pa.int64()] * 6, pa.float64(), pa.bool_(), pa.bool_()]
        return [pa.array([x.decode() for x in columns[0]], kinds[0]),
                *[pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True)]]

    def judge(self, text: bytes):
        lines, words = text.split(b"\n"), text.split()
        counts = byte_counts(text)
        n, repeated = len(words), repeated_words(word_ids(words))
        blanks = int(counts[[9, 10, 11, 12, 13, 32]].sum())
        base_failed = n < self.min_words or repeated > self.max_repeated * n
        bad = [failing(x) is not None for x in lines]
        lost = sum(len(x.split()) for x, b in zip(lines, bad, strict=True) if b)
        kept_text = b"\n".join(x for x, b in zip(lines, bad, strict=True) if not b) if any(bad) else text
        share = lost / n if n else 0.0
        return (kept_text, n, code_points(counts) - blanks, int(counts[SYMBOL_BYTES].sum()), repeated_lines(lines),
                repeated, sum(bad), share, base_failed, not base_failed and share <= self.max_lost)


FIELDS = ("clean_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_removed_lines long, lost_share double, base_failed boolean, kept boolean")


def judge_documents(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS,
                    max_repeated: float = MAX_REPEATED, max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with the cleaned text, the figures and the verdict of every document; no shuffle."""
    return map_texts(docs, FIELDS, Rules(min_words, max_repeated, max_lost), text_col)


def q_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                        "n_repeat_words", "base_failed", "kept", "n_removed_lines", "lost_share")

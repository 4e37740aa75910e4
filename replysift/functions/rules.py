"""M11(a): the native rule scorer as Catalyst expressions.

One regex pass per text collects every phrase of every category, the longest at
each place, then each category counts its own; neutral phrases ("not corrected")
are read but counted for none.
The whole text is scanned: no prefix, no sampling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_RULES, RuleSet
from .text import col_of, named

# ASCII word boundary written with look-arounds: Java's ``\b`` treats any
# Unicode letter as a word character, which would make "édone" differ from
# engines whose ``\b`` is ASCII-only.
_WORD_BEFORE = "(?<![a-z0-9_])"
_WORD_AFTER = "(?![a-z0-9_])"


def normalised_text(c: Column | str) -> Column:
    """Lower case with the typographic apostrophe folded to ``'``."""
    return F.regexp_replace(F.lower(col_of(c)), "’", "'")


def _trie_alternation(words) -> str:
    """Alternation of ``words`` factored by common prefixes (``c(?:an't|annot)``),
    so that at each position the regex engine follows one branch per character
    instead of trying every word. Longer words are preferred, as in a
    longest-first alternation; the trailing word-boundary check decides."""
    trie: dict = {}
    for w in words:
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node) -> str:
        ends = "" in node
        alts = [ch + build(node[ch]) for ch in sorted(k for k in node if k)]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        if ends:
            return "(?:" + body + ")?"
        return body

    return build(trie)


def cue_regex(rules: RuleSet = DEFAULT_RULES) -> str:
    words = sorted(rules.phrases)
    parts = []
    if any(r.question_mark for r in rules.rules):
        parts.append("\\?")
    if words:
        parts.append(_WORD_BEFORE + "(?:" + _trie_alternation(words) + ")" + _WORD_AFTER)
    return "|".join(parts)


def cue_matches(c: Column | str, rules: RuleSet = DEFAULT_RULES) -> Column:
    return F.regexp_extract_all(normalised_text(c), F.lit(cue_regex(rules)), 0)


def cue_counts(matches: Column, rules: RuleSet = DEFAULT_RULES) -> list[Column]:
    """One integer count per rule, in rule order."""
    def member_of(cues, question_mark):
        # one-argument lambda: Spark passes as many variables as it has parameters
        def hit(x):
            cond = x.isin(*cues) if cues else F.lit(False)
            return cond | (x == F.lit("?")) if question_mark else cond
        return hit

    return [F.size(F.filter(matches, member_of(r.cues, r.question_mark))) for r in rules.rules]


def _winner(counts: list[Column], rules: RuleSet) -> list[tuple[Column, str, Column]]:
    """(condition, label, winning count) per rule, in priority order."""
    out = []
    for i, (r, n) in enumerate(zip(rules.rules, counts)):
        cond = n > 0
        if not r.overriding:
            for later in counts[i + 1:]:
                cond = cond & (n >= later)
        out.append((cond, r.label, n))
    return out


def rule_label(counts: list[Column], rules: RuleSet = DEFAULT_RULES) -> Column:
    branches = _winner(counts, rules)
    expr = None
    for cond, label, _ in branches:
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(rules.default_label))


def rule_confidence(counts: list[Column], rules: RuleSet = DEFAULT_RULES) -> Column:
    """``base + (weight * winner) / total``; a fixed value when no cue is found."""
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    win = None
    for cond, _, n in _winner(counts, rules):
        win = F.when(cond, n) if win is None else win.when(cond, n)
    win = win.otherwise(F.lit(0))
    share = (F.lit(rules.share_weight) * win.cast("double")) / total.cast("double")
    return (
        F.when(total == 0, F.lit(rules.no_cue_confidence))
        .otherwise(F.lit(rules.base_confidence) + share)
    )


def rule_reasoning(counts: list[Column], rules: RuleSet = DEFAULT_RULES) -> Column:
    """Short explanation: the cue count of every category."""
    parts = [F.lit("cues:")]
    for i, (r, n) in enumerate(zip(rules.rules, counts)):
        parts += [F.lit((", " if i else " ") + r.label + " "), n.cast("string")]
    return F.concat(*parts)


def rule_score(c: Column | str, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Struct(label, confidence, reasoning) for one answer text."""
    counts = cue_counts(cue_matches(c, rules), rules)
    return F.struct(
        rule_label(counts, rules).alias("label"),
        rule_confidence(counts, rules).alias("confidence"),
        rule_reasoning(counts, rules).alias("reasoning"),
    )


def rule_score_struct(c: Column | str, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Struct(label, confidence, reasoning) in which the regex pass appears once.

    Intermediate values are bound as lambda variables (``transform`` over a
    one-element array), so the expression tree holds the regex and the counts
    once each. That matters beyond this projection: when a filter on the label
    or the confidence is pushed below the projection, the optimizer copies the
    defining expression into the filter, and a tree that mentions the regex
    once per use of a count would scan the text a dozen times per row.
    """
    k = len(rules.rules)

    def from_counts(cs: Column) -> Column:
        cl = [cs[f"n{i}"] for i in range(k)]
        return F.struct(
            rule_label(cl, rules).alias("label"),
            rule_confidence(cl, rules).alias("confidence"),
            rule_reasoning(cl, rules).alias("reasoning"),
        )

    def from_matches(m: Column) -> Column:
        counts = F.struct(*[n.alias(f"n{i}") for i, n in enumerate(cue_counts(m, rules))])
        return F.transform(F.array(counts), from_counts)[0]

    return F.transform(F.array(cue_matches(c, rules)), from_matches)[0]


def with_rule_score(df, text_col: str, rules: RuleSet = DEFAULT_RULES, valid: Column | None = None,
                    prefix: str = "_rule"):
    """Add ``{prefix}_label``, ``{prefix}_confidence``, ``{prefix}_reasoning``.

    The score is one struct column (one text scan per row); with ``valid``
    given, invalid rows skip the scan.
    """
    text = named(text_col)
    if valid is not None:
        text = F.when(valid, text)
    s = f"{prefix}_score"
    df = df.withColumn(s, rule_score_struct(text, rules))
    return df.withColumns({
        f"{prefix}_label": F.col(s)["label"],
        f"{prefix}_confidence": F.col(s)["confidence"],
        f"{prefix}_reasoning": F.col(s)["reasoning"],
    }).drop(s)

"""M12, categories as a table: cue phrases of any number, matched by a join instead of a regex.

A text is cut into words (``[a-z0-9_]+`` in lower case) and what stands between them. Every run of up to
``longest`` words, with its gaps, is a gram; grams meet the phrase table in an equi-join on
their hash and text, so the table may hold a million phrases and neither plan nor pattern grows with it. A
table of up to ``BROADCAST_BYTES`` is sent to the texts, so that no gram moves; Spark can't tell by itself
which side is small, and would move the grams, many times the texts. Of
overlapping matches the leftmost counts, and of those that begin together the longest, as a
regex with all phrases, longest first, reads them.

Tables: phrases (label, phrase), a null label or one that is no category marking a phrase that is read
but counts for nothing; categories (label, priority, overriding, question_mark), in order of priority.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RuleSet
from .rules import normalised_text
from .text import named

PIECES = "[a-z0-9_]+|[^a-z0-9_]+"
#: Categories that ``read_categories`` brings to the driver at most; phrases stay a table.
MOST_CATEGORIES = 200
#: Bytes of phrases up to which the phrase table goes to the texts; a larger one meets the grams in a shuffle.
BROADCAST_BYTES = 32 << 20


def rule_tables(spark: SparkSession, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(phrases, categories) of a rule set."""
    phrases = [(r.label, c) for r in rules.rules for c in r.cues] + [(None, c) for c in rules.neutral]
    categories = [(r.label, i, r.overriding, r.question_mark) for i, r in enumerate(rules.rules)]
    return (spark.createDataFrame(phrases, "label string, phrase string"),
            spark.createDataFrame(categories, "label string, priority int, overriding boolean, question_mark boolean"))


def read_categories(categories: DataFrame) -> list:
    rows = categories.orderBy("priority", "label").limit(MOST_CATEGORIES + 1).collect()
    if not rows or len(rows) > MOST_CATEGORIES:
        raise ValueError(f"between 1 and {MOST_CATEGORIES} categories are needed")
    if len({r["label"] for r in rows}) != len(rows) or any(r["label"] is None for r in rows):
        raise ValueError("category names must be unique and not null")
    return rows


def checked_phrases(phrases: DataFrame, labels: list[str]) -> DataFrame:
    """(phrase, rule, words): each phrase once, with the place of its category (-1: counts for nothing).
    A phrase with two categories, or that doesn't begin and end with a letter or digit, fails."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
    one = phrases.select("phrase", F.coalesce(place, F.lit(-1)).alias("rule")).groupBy("phrase").agg(F.min("rule").alias("rule"), F.max("rule").alias("other"))
    good = F.col("phrase").rlike("^[a-z0-9]([^?]*[a-z0-9])?$") & (F.col("rule") == F.col("other"))
    fail = F.raise_error(F.concat(F.lit("no usable phrase, or one of two categories: "), F.coalesce("phrase", F.lit("null")))).cast("string")
    one = one.withColumn("phrase", F.when(good, F.col("phrase")).otherwise(fail))
    return one.select("phrase", "rule", F.size(F.regexp_extract_all("phrase", F.lit("[a-z0-9_]+"), 0)).alias("words"))


def grams(text: Column, longest: int) -> Column:
    """array<struct<at, words, gram>> of all runs of 1 to ``longest`` words; ``at`` counts words."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), 0)

    def of_pieces(p: Column) -> Column:
        lead = F.when(F.get(p, F.lit(0)).rlike("^[a-z0-9_]"), 0).otherwise(1)  # pieces before the first word
        n = F.floor((F.size(p) - lead + 1) / 2).cast("int")

        def at(i: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: F.struct(
                i.alias("at"), k.alias("words"), F.array_join(F.slice(p, lead + 2 * i + 1, 2 * k - 1), "").alias("gram")))

        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, at))

    return F.transform(F.array(pieces), of_pieces)[0]


def _counted(found: Column, n_rules: int) -> Column:
    """Counts of the rules over matches (at, words, rule) sorted by place, the longest first of each: a
    match that begins before the last one ended is passed over."""
    start = F.struct(F.lit(0).alias("free"), F.array_repeat(F.lit(0), n_rules).alias("counts"))

    def take(state: Column, m: Column) -> Column:
        counts = F.transform(state["counts"], lambda c, i: c + F.when(i == m["rule"], 1).otherwise(0))
        return F.when(m["at"] >= state["free"], F.struct((m["at"] + m["words"]).alias("free"), counts.alias("counts"))).otherwise(state)

    return F.aggregate(found, start, take)["counts"]


def table_scores(texts: DataFrame, key: str, text_col: str, phrases: DataFrame, categories: DataFrame, default_label: str,
                 no_cue_confidence: float = 0.5, base_confidence: float = 0.3, share_weight: float = 0.65) -> DataFrame:
    """(key, label, confidence, reasoning) for the rows of ``texts``; ``key`` is unique. The rules for label,
    confidence and reasoning are those of ``functions.rules``."""
    rules = read_categories(categories)
    labels = [r["label"] for r in rules]
    table = checked_phrases(phrases, labels)
    # 40: a row's other columns
    longest, size = table.agg(F.coalesce(F.max("words"), F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase") + 40), F.lit(0))).first()
    text = normalised_text(named(text_col))
    rows = texts.select(named(key).alias("_k"), text.alias("_t"))
    each = rows.select("_k", F.inline(grams(F.col("_t"), longest)))
    hashed = table.withColumn("_h", F.xxhash64("phrase")).drop("words")
    if size <= BROADCAST_BYTES:
        hashed = F.broadcast(hashed)
    met = each.withColumn("_h", F.xxhash64("gram")).join(hashed, "_h").where("gram = phrase")
    # of the longest first: the order of the struct is place, then fewer words last
    found = met.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("words")).alias("less"), "words", "rule"))).alias("_m"))
    marks = F.regexp_count("_t", F.lit("\\?"))
    joined = rows.select("_k", marks.alias("_q")).join(found, "_k", "left")
    counted = F.coalesce(_counted(F.col("_m"), len(rules)), F.array_repeat(F.lit(0), len(rules)))
    asks = F.array(*[F.lit(bool(r["question_mark"])) for r in rules])
    counts = F.zip_with(counted, asks, lambda c, q: c + F.when(q, F.col("_q")).otherwise(0))
    over = F.array(*[F.lit(bool(r["overriding"])) for r in rules])

    def scored(c: Column) -> Column:
        wins = F.transform(c, lambda n, i: (n > 0) & (F.get(over, i) | (n >= F.array_max(F.slice(c, i + 1, len(rules))))))
        place = F.array_position(wins, F.lit(True)).cast("int")
        total = F.aggregate(c, F.lit(0), lambda a, b: a + b)
        win = F.coalesce(F.get(c, place - 1), F.lit(0))
        said = F.array_join(F.zip_with(F.array(*[F.lit(x) for x in labels]), c, lambda x, n: F.concat(x, F.lit(" "), n.cast("string"))), ", ")
        share = F.lit(share_weight) * win.cast("double") / F.when(total > 0, total.cast("double"))
        return F.struct(
            F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), place - 1), F.lit(default_label)).alias("label"),
            F.when(total == 0, F.lit(no_cue_confidence)).otherwise(F.lit(base_confidence) + share).alias("confidence"),
            F.concat(F.lit("cues:"), F.lit(" "), said).alias("reasoning"))

    one = joined.select("_k", F.transform(F.array(counts), scored)[0].alias("_s"))
    return one.select(F.col("_k").alias(key), "_s.label", "_s.confidence", "_s.reasoning")

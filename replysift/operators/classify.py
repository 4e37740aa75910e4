"""Validation and classification of a listing.

``classify`` is one narrow pass: no shuffle, no Python, no action. It accepts a
batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    CONFIDENCE, DEFAULT_COLUMNS, DEFAULT_RULES, HUMAN_REVIEWED, INVALID_LABEL,
    INVALID_REASONING, IS_VALID, LABEL, REASONING, ROW_KEY, ListingColumns, RuleSet,
)
from ..functions.noise import Transitions
from ..functions.phrases import table_scores
from ..functions.rules import with_rule_score
from ..functions.text import named
from ..functions.validity import is_valid_response, looks_like_gibberish
from ..sources.listing import check_columns, check_no_output_collision


def validate(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, reject_gibberish: bool | Transitions = False) -> DataFrame:
    """P1 (+ optional D3: by the plain rule, or by learned ``Transitions``): add ``Is_Valid``.
    Raises when the response column is missing or an output column already exists."""
    check_columns(df, cols)
    check_no_output_collision(df)
    valid = is_valid_response(named(cols.response))
    if isinstance(reject_gibberish, Transitions):
        valid = valid & ~reject_gibberish.is_noise(named(cols.response))
    elif reject_gibberish:
        valid = valid & ~looks_like_gibberish(named(cols.response))
    return df.withColumn(IS_VALID, valid)


def validity_counts(validated: DataFrame) -> DataFrame:
    """A1: valid, invalid and total rows in one aggregate."""
    v = F.col(IS_VALID)
    return validated.agg(
        F.count_if(v).cast("long").alias("n_valid"),
        F.count_if(~v).cast("long").alias("n_invalid"),
        F.count(F.lit(1)).cast("long").alias("n_total"),
    )


def stamp_results(df: DataFrame, label: Column, confidence: Column, reasoning: Column) -> DataFrame:
    """Valid rows take the scorer's result, invalid rows the fixed
    ``INVALID`` stamp; no split and no union, one projection."""
    v = F.col(IS_VALID)
    return df.withColumns({
        LABEL: F.when(v, label).otherwise(F.lit(INVALID_LABEL)),
        CONFIDENCE: F.when(v, confidence.cast("double")).otherwise(F.lit(None).cast("double")),
        REASONING: F.when(v, reasoning).otherwise(F.lit(INVALID_REASONING)),
        HUMAN_REVIEWED: F.lit(False),
    })


def classify(
    df: DataFrame,
    cols: ListingColumns = DEFAULT_COLUMNS,
    rules: RuleSet = DEFAULT_RULES,
    reject_gibberish: bool | Transitions = False,
) -> DataFrame:
    """Classified listing with the native rule scorer: every input column and
    row kept, plus ``Is_Valid, LLM_Classification, Confidence, Reasoning,
    Human_Reviewed``. Invalid rows skip the regex scan."""
    validated = validate(df, cols, reject_gibberish)
    scored = with_rule_score(validated, cols.response, rules, valid=F.col(IS_VALID), prefix="_rs")
    out = stamp_results(
        scored, F.col("_rs_label"), F.col("_rs_confidence"), F.col("_rs_reasoning")
    )
    return out.drop("_rs_label", "_rs_confidence", "_rs_reasoning")


def classify_by_table(df: DataFrame, phrases: DataFrame, categories: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS,
                      default_label: str = DEFAULT_RULES.default_label, key: str = ROW_KEY) -> DataFrame:
    """``classify`` with categories that are tables (see ``functions.phrases``), for more phrases
    than a pattern can hold. Rows need a unique ``key``; valid answers meet the phrases in a join on their
    words, and results come back by the key."""
    validated = validate(df, cols)
    scores = table_scores(validated.where(F.col(IS_VALID)), key, cols.response, phrases, categories, default_label)
    scores = scores.select(named(key).alias("_sk"), F.col("label").alias("_sl"), F.col("confidence").alias("_sc"), F.col("reasoning").alias("_sr"))
    joined = validated.join(scores, named(key) == F.col("_sk"), "left")
    return stamp_results(joined, F.col("_sl"), F.col("_sc"), F.col("_sr")).drop("_sk", "_sl", "_sc", "_sr")

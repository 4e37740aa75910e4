"""Human review loop.

Corrections are a table ``(row_key, corrected_label, seq)``; a later ``seq``
wins. Applying them is an equi left join on ``row_key``: adaptive execution
broadcasts the correction side when its runtime size is small and falls back
to a sort-merge join otherwise, so no size is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    CATEGORIES, CONFIDENCE, CORRECTED_CONFIDENCE, CORRECTED_REASONING, DEFAULT_COLUMNS,
    FALLBACK_LABEL, HUMAN_REVIEWED, INVALID_LABEL, LABEL, LOW_CONFIDENCE_DEFAULT,
    ORIGINAL_LABEL, REASONING, REVIEW_PAGE_ROWS, ROW_KEY, ListingColumns,
)
from ..functions.text import named
from .analytics import valid_only
from .filters import low_confidence


def review_queue(df: DataFrame, threshold: float = LOW_CONFIDENCE_DEFAULT, mode: str = "low") -> DataFrame:
    """``low`` = valid rows below the threshold (null confidence left out);
    ``all`` = every valid row."""
    if mode == "low":
        return low_confidence(df, threshold)
    if mode == "all":
        return valid_only(df)
    raise ValueError(f"unknown review mode {mode!r}")


def review_page(queue: DataFrame, n: int = REVIEW_PAGE_ROWS, order: str = "confidence",
                key: str = ROW_KEY) -> DataFrame:
    """L3: the first ``n`` rows to review; ``confidence`` = lowest first, or
    ``key`` = row-key order. Both orders are total (ties by row key), so the page
    is the same on every run. Planned as a take-ordered top-k."""
    if order == "confidence":
        return queue.orderBy(F.asc_nulls_last(CONFIDENCE), F.asc(key)).limit(n)
    if order == "key":
        return queue.orderBy(F.asc(key)).limit(n)
    raise ValueError(f"unknown review order {order!r}")


def latest_corrections(corrections: DataFrame, categories=CATEGORIES) -> DataFrame:
    """One decision per row key: the label with the highest ``seq``; a null ``seq``
    comes before all others, and of equal ones the category later in ``categories``
    wins. Labels outside ``categories`` are dropped (see ``ignored_corrections``).

    Seq and category are one number, so this is a hash aggregate with partial sums: a
    key corrected very often is no hot spot."""
    n = len(categories)
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("corrected_label"))
    seq = F.coalesce(F.col("seq").cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    latest = (
        corrections.where(F.col("corrected_label").isin(*categories) & F.col(ROW_KEY).isNotNull())
        .select(ROW_KEY, (seq * F.lit(n).cast("decimal(10,0)") + (place - 1).cast("decimal(10,0)")).cast("decimal(38,0)").alias("_last"))
        .groupBy(ROW_KEY).agg(F.max("_last").alias("_last"))
    )
    which = F.pmod(F.col("_last"), F.lit(n).cast("decimal(10,0)")).cast("int")
    return latest.select(ROW_KEY, F.element_at(F.array(*[F.lit(c) for c in categories]), which + 1).alias("corrected_label"))


def deciding_corrections(corrections: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Of each row key the correction (row_key, corrected_label, seq) that ``latest_corrections`` goes by.
    A maximum in one hash aggregate: the order of the rows doesn't matter, and it may be
    applied again to its own result and more rows."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("corrected_label"))
    rank = F.struct(F.col("seq").isNotNull().alias("given"), F.col("seq").alias("seq"), place.alias("place"), "corrected_label")
    usable = corrections.where(F.col("corrected_label").isin(*categories) & F.col(ROW_KEY).isNotNull())
    last = usable.groupBy(ROW_KEY).agg(F.max(rank).alias("last"))
    return last.select(ROW_KEY, "last.corrected_label", "last.seq")


def ignored_corrections(df: DataFrame, corrections: DataFrame, categories=CATEGORIES, key: str = ROW_KEY) -> DataFrame:
    """Corrections that ``apply_corrections`` leaves out, with the reason: no row key, a
    label that is no category, no such row, or a row without a valid answer."""
    known = df.select(named(key).alias("_k"), F.col(LABEL).alias("_l"))
    j = corrections.join(known, F.col(ROW_KEY) == F.col("_k"), "left")
    reason = (
        F.when(F.col(ROW_KEY).isNull(), F.lit("no row key"))
        .when(~F.coalesce(F.col("corrected_label").isin(*categories), F.lit(False)), F.lit("unknown label"))
        .when(F.col("_k").isNull(), F.lit("unknown row"))
        .when(F.col("_l") == F.lit(INVALID_LABEL), F.lit("invalid answer"))
    )
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(ROW_KEY, "corrected_label", "seq", "reason")


def pending_corrections(page: DataFrame, proposals: DataFrame | None = None,
                        categories=CATEGORIES, key: str = ROW_KEY) -> DataFrame:
    """R2: rows of a review page whose chosen label differs from the current one.

    Without a proposal a row keeps its label when that is a category, and
    defaults to ``Miscellaneous`` otherwise (so an unknown label is pending at
    once, as in the original tool)."""
    cur = F.col(LABEL)
    default = F.when(cur.isin(*categories), cur).otherwise(F.lit(FALLBACK_LABEL))
    if proposals is not None:
        # only the page's keys are aggregated, however many proposals there are
        own = page.select(named(key).alias(ROW_KEY)).distinct()
        p = latest_corrections(proposals.join(own, ROW_KEY, "left_semi"), categories).withColumnRenamed(ROW_KEY, key)
        page = page.join(p, key, "left")
        chosen = F.coalesce(F.col("corrected_label"), default)
    else:
        chosen = default
    return (
        page.withColumn("_chosen", chosen)
        .where(~F.col("_chosen").eqNullSafe(cur))
        .select(F.col(key).alias(ROW_KEY), cur.alias("current_label"),
                F.col("_chosen").alias("corrected_label"))
    )


def apply_corrections(df: DataFrame, corrections: DataFrame, keep_original: bool = True,
                      categories=CATEGORIES, key: str = ROW_KEY) -> DataFrame:
    """For each corrected row, label := correction, ``Human_Reviewed`` :=
    true, ``Confidence`` := 1.0, ``Reasoning`` := fixed text. Other rows are
    untouched; ``INVALID`` rows are never corrected. With ``keep_original`` the
    label before the first correction is kept in ``Original_Classification``
    (D4). Applying the same corrections twice equals applying them once."""
    latest = latest_corrections(corrections, categories).select(
        F.col(ROW_KEY).alias("_ck"), F.col("corrected_label").alias("_cl")
    )
    j = df.join(latest, F.col(key) == F.col("_ck"), "left")
    hit = F.col("_cl").isNotNull() & ~F.col(LABEL).eqNullSafe(F.lit(INVALID_LABEL))

    def before(name, kind):  # a frame without the column gains it
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    cols = {
        LABEL: F.when(hit, F.col("_cl")).otherwise(F.col(LABEL)),
        HUMAN_REVIEWED: F.when(hit, F.lit(True)).otherwise(before(HUMAN_REVIEWED, "boolean")),
        CONFIDENCE: F.when(hit, F.lit(CORRECTED_CONFIDENCE)).otherwise(before(CONFIDENCE, "double")),
        REASONING: F.when(hit, F.lit(CORRECTED_REASONING)).otherwise(before(REASONING, "string")),
    }
    if keep_original:
        prior = F.col(ORIGINAL_LABEL) if ORIGINAL_LABEL in df.columns else F.lit(None).cast("string")
        cols = {ORIGINAL_LABEL: F.when(hit, F.coalesce(prior, F.col(LABEL))).otherwise(prior), **cols}
    return j.withColumns(cols).drop("_ck", "_cl")


def label_agreement(corrected: DataFrame, categories=CATEGORIES) -> DataFrame:
    """Over human-reviewed rows, model label x reviewer label counts (one
    row per model label, one column per category) and the agreement share."""
    rev = corrected.where(F.col(HUMAN_REVIEWED) & F.col(ORIGINAL_LABEL).isNotNull())
    lab, orig = F.col(LABEL), F.col(ORIGINAL_LABEL)
    # one aggregate: a count per reviewer label instead of a pivot plus a join
    g = rev.groupBy(orig.alias("model_label")).agg(
        *[F.count_if(lab == F.lit(c)).cast("long").alias(c) for c in categories],
        F.count(F.lit(1)).cast("long").alias("n_reviewed"),
        F.count_if(orig == lab).cast("long").alias("n_agree"),
    )
    return g.withColumn(
        "agreement", F.col("n_agree").cast("double") / F.col("n_reviewed").cast("double")
    )


def affirmative_worklist(df: DataFrame, audit: DataFrame | None = None,
                         cols: ListingColumns = DEFAULT_COLUMNS, audit_key: str | None = None) -> DataFrame:
    """Affirmative answers to verify against the audit trail. With an audit
    table, ``has_audit_change`` tells whether any change was logged for the
    query id (audit keys are made distinct first, so a busy key cannot
    multiply rows)."""
    wanted = [c for c in (ROW_KEY, cols.query_id, cols.study, cols.site, cols.item, cols.response)
              if c in df.columns]
    w = valid_only(df).where(F.col(LABEL) == F.lit("Affirmative")).select(*[F.col(f"`{c}`") for c in wanted])
    if audit is None:
        return w
    ak = audit_key or cols.query_id
    keys = audit.where(F.col(f"`{ak}`").isNotNull()).groupBy(F.col(f"`{ak}`").alias("_ak")).agg(
        F.count(F.lit(1)).cast("long").alias("n_audit_changes")
    )
    j = w.join(keys, F.col(f"`{cols.query_id}`") == F.col("_ak"), "left")
    return j.withColumn("has_audit_change", F.col("_ak").isNotNull()).withColumn(
        "n_audit_changes", F.coalesce(F.col("n_audit_changes"), F.lit(0).cast("long"))
    ).drop("_ak")

"""Filters and listings over a classified listing.

Every filter is a plain predicate, so chained filters merge into one and, over a
Parquet stage table, reach the scan as pushed filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    CATEGORIES, CONFIDENCE, DEFAULT_COLUMNS, HIGH_BAND, IS_VALID, LABEL, LOW_CONFIDENCE_DEFAULT,
    MEDIUM_BAND, PREVIEW_CHARS, REASONING, ROW_KEY, ListingColumns,
)
from ..functions.text import named, preview
from ..sources.places import input_positions
from ..sources.sinks import stage_root
from .analytics import valid_only

ALL = "All"
#: Bits of a draw that tell its bin in ``exact_sample``: 4,096 bins for each stratum.
DRAW_BITS = 12


def confidence_band(c: Column | None = None) -> Column:
    """P8 as a column: High >= 0.8, Medium [0.6, 0.8), Low < 0.6, null otherwise."""
    c = F.col(CONFIDENCE) if c is None else c
    return (
        F.when(c >= F.lit(HIGH_BAND), F.lit("High"))
        .when((c >= F.lit(MEDIUM_BAND)) & (c < F.lit(HIGH_BAND)), F.lit("Medium"))
        .when(c < F.lit(MEDIUM_BAND), F.lit("Low"))
    )


def band_predicate(band: str) -> Column:
    """``All`` keeps every row (null confidence too); other bands drop nulls."""
    c = F.col(CONFIDENCE)
    if band == ALL:
        return F.lit(True)
    if band == "High":
        return c >= F.lit(HIGH_BAND)
    if band == "Medium":
        return (c >= F.lit(MEDIUM_BAND)) & (c < F.lit(HIGH_BAND))
    if band == "Low":
        return c < F.lit(MEDIUM_BAND)
    raise ValueError(f"unknown confidence band {band!r}")


def results_predicate(
    df: DataFrame,
    categories=CATEGORIES,
    band: str = ALL,
    item: str = ALL,
    cols: ListingColumns = DEFAULT_COLUMNS,
) -> Column:
    """P7 AND P8 AND P9 as one predicate. The item filter is skipped when the
    item column is absent."""
    preds = [F.col(LABEL).isin(*categories), band_predicate(band)]
    if item != ALL and cols.item in df.columns:
        preds.append(named(cols.item) == F.lit(item))
    return reduce(lambda a, b: a & b, preds)


def filter_results(df: DataFrame, categories=CATEGORIES, band: str = ALL, item: str = ALL,
                   cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """P10: rows matching the category, confidence-band and item choices."""
    return df.where(results_predicate(df, categories, band, item, cols))


def shown_of_total(df: DataFrame, categories=CATEGORIES, band: str = ALL, item: str = ALL,
                   cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``shown`` rows of ``total`` (all rows, invalid included), one aggregate."""
    pred = results_predicate(df, categories, band, item, cols)
    return df.agg(
        F.count_if(F.coalesce(pred, F.lit(False))).cast("long").alias("shown"),
        F.count(F.lit(1)).cast("long").alias("total"),
    )


def filter_options(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Distinct non-null items, ascending (the ``All`` choice is added by a UI)."""
    return (
        df.select(named(cols.item).alias("item"))
        .where(F.col("item").isNotNull())
        .distinct()
        .orderBy("item")
    )


def low_confidence(df: DataFrame, threshold: float = LOW_CONFIDENCE_DEFAULT) -> DataFrame:
    """Valid rows with confidence strictly below ``threshold``."""
    return valid_only(df).where(F.col(CONFIDENCE) < F.lit(threshold))


def medical_listing(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Medically related rows, projected to the id, study, item, answer and
    reasoning columns that exist (all columns when none do)."""
    med = valid_only(df).where(F.col(LABEL) == F.lit("Medically Related"))
    wanted = [c for c in (cols.query_id, cols.study, cols.item, cols.response, REASONING) if c in df.columns]
    return med.select(*[F.col(f"`{c}`") for c in wanted]) if wanted else med


def confused_rows(df: DataFrame) -> DataFrame:
    """P15."""
    return valid_only(df).where(F.col(LABEL) == F.lit("Confused"))


def review_preview(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, n: int = PREVIEW_CHARS) -> DataFrame:
    """Display columns of a review row. The full answer stays in the row;
    ``preview`` is its first ``n`` characters, for display only."""
    return df.withColumn("preview", preview(named(cols.response), n))


def export_order(df: DataFrame, key: str = ROW_KEY) -> DataFrame:
    """Valid rows first, then invalid, each by row key (a total order).
    Apply only right before an export: a CSV written from it keeps the order
    across its part files (range-partitioned sort)."""
    return df.orderBy(F.desc(IS_VALID), F.asc(key))


def export_positions(df: DataFrame, key: str = ROW_KEY, pos_col: str = "row_pos",
                     n_partitions: int | None = None) -> DataFrame:
    """L5 + U1: the 0-based position of every row in export order (the renumbered
    index of the original tool's output: valid rows, then invalid, here each by
    row key). Action: the ordered rows are checkpointed once.

    No window over the whole table (that would pull every row into one task):
    rows are range-partitioned on the export order, sorted within each
    partition and checkpointed into the shared checkpoint folder. The range
    bounds come from a sample whose seed depends on the plan, so two branches
    that each re-ran the range exchange could disagree; the checkpoint fixes
    one partitioning (it keeps partitions and their order) and a lost executor
    re-reads it instead of re-sampling. The local index is the row's number
    inside its partition (``monotonically_increasing_id`` is partition index
    << 33 plus the record number). Each partition is shifted by the row count
    of all earlier partitions: a table with one row per partition, so its size
    is bounded by the partition count and it is broadcast. ``key`` must be
    unique (a total order).
    """
    order = [F.desc(IS_VALID), F.asc(key)]
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stage_root(spark)  # the checkpoint folder must be set (a shared one on a cluster)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint(eager=True)
    part, local = "_xp_part", "_xp_local"
    numbered = ranged.withColumns({
        part: F.spark_partition_id(),
        local: F.monotonically_increasing_id(),
    }).withColumn(local, F.col(local) - F.shiftleft(F.col(part).cast("long"), 33))
    sizes = ranged.groupBy(F.spark_partition_id().alias(part)).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        part,
        F.coalesce(
            F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).cast("long").alias("_xp_off"),
    )
    out = numbered.join(F.broadcast(offsets), part, "left")
    return out.withColumn(pos_col, (F.coalesce(F.col("_xp_off"), F.lit(0)) + F.col(local)).cast("long")).drop(
        part, local, "_xp_off"
    )


def input_export_positions(classified: DataFrame, pos_col: str = "row_pos") -> DataFrame:
    """L5 + U1 in input order: valid rows in the order of the input, then invalid rows in theirs.
    ``classified`` is stored and carries places (``sources.places.with_place``)."""
    return input_positions(classified, [F.col(IS_VALID)], pos_col)


def sample_listing(df: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    """Bernoulli sample of a listing, e.g. to try a model on part of a large file."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def _stratum_fraction(strata_col: str | None, fractions: dict[str, float] | None, default: float) -> Column:
    """The fraction of a row's stratum from a literal map (no job to collect strata)."""
    if strata_col and fractions:
        m = F.create_map(*[x for k, v in fractions.items() for x in (F.lit(k), F.lit(float(v)))])
        return F.coalesce(F.try_element_at(m, named(strata_col)), F.lit(float(default)))
    return F.lit(float(default))


def stratified_sample(
    df: DataFrame, strata_col: str, fractions: dict[str, float], seed: int = 7, default: float = 0.0
) -> DataFrame:
    """Per-stratum fractions (e.g. by study) without collecting the strata:
    the fraction is looked up in a literal map and compared with a seeded
    uniform draw."""
    return df.where(F.rand(seed) < _stratum_fraction(strata_col, fractions, default))


def key_sample(
    df: DataFrame, fraction: float = 0.0, strata_col: str | None = None,
    fractions: dict[str, float] | None = None, seed: int = 7, key: str = ROW_KEY,
) -> DataFrame:
    """D6, reproducible: a row is kept when the first 32 bits of
    ``md5("<seed>|<key>")``, read as a number in [0, 2^32), fall below its
    stratum's fraction times 2^32. The draw depends on the row key only, so
    the sample is the same for any partitioning, on a retried task and in
    another engine; ``stratified_sample``'s ``rand`` draw depends on the
    partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return df.where(draw < _stratum_fraction(strata_col, fractions, fraction) * F.lit(4294967296.0))


def exact_sample(df: DataFrame, n: int, strata_col: str | None = None, seed: int = 7, key: str = ROW_KEY) -> DataFrame:
    """D6, exact size: the ``n`` rows of each stratum (all rows of a smaller one; null is a stratum)
    with the least draws, a draw being the first 32 bits of ``md5("<seed>|<key>")``, ties by key.

    No stratum is sorted or passes through one task: draws are counted in ``2 ** DRAW_BITS`` equal bins for
    each stratum (a hash aggregate with partial sums, of bounded size), a prefix sum finds the bin in which the
    n-th row lies, rows of lower bins stay as they are, and only rows of that one bin are ranked.
    The sample depends on the keys only, not on the layout of the data."""
    if n < 0:
        raise ValueError("n must not be negative")
    stratum = named(strata_col) if strata_col else F.lit(None).cast("string")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), named(key).cast("string"))), 1, 8), 16, 10).cast("long")
    # keys of a stratum as one text, so that null and any value differ
    d = df.withColumns({"_xs": F.when(stratum.isNull(), "N").otherwise(F.concat(F.lit("V"), stratum.cast("string"))), "_xd": draw})
    d = d.withColumn("_xb", F.shiftright("_xd", 32 - DRAW_BITS))
    bins = d.groupBy("_xs", "_xb").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("_xs").orderBy("_xb").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("c").over(upto))
    cut = bins.where(F.col("upto") >= n).groupBy("_xs").agg(F.min(F.struct("_xb", "upto", "c")).alias("cut"))
    cut = cut.select("_xs", F.col("cut._xb").alias("_xc"), (F.lit(n) - (F.col("cut.upto") - F.col("cut.c"))).alias("_xn"))
    j = d.join(cut, "_xs", "left").where(F.col("_xc").isNull() | (F.col("_xb") <= F.col("_xc")))
    inner = j.where(F.col("_xc").isNull() | (F.col("_xb") < F.col("_xc")))
    edge = j.where(F.col("_xb") == F.col("_xc")).withColumn("_xr", F.row_number().over(Window.partitionBy("_xs").orderBy("_xd", named(key))))
    edge = edge.where(F.col("_xr") <= F.col("_xn")).drop("_xr")
    return inner.unionByName(edge).drop("_xs", "_xd", "_xb", "_xc", "_xn")

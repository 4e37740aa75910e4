"""Aggregates over a classified listing.

All are hash aggregates with map-side partial aggregation, so a hot study,
item or label costs one partial row per task rather than one huge group.
Results are small; ordering is applied only to those small results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import named
from ..config import (
    CATEGORIES, CONFIDENCE, CONFUSION_ALERT_RATE, DEFAULT_COLUMNS, HISTOGRAM_BINS,
    INVALID_LABEL, LABEL, LOW_CONFIDENCE_DEFAULT, TOP_ITEMS_SUMMARY, ListingColumns,
)

from ..sources.sinks import stage


def valid_only(df: DataFrame) -> DataFrame:
    """Rows whose label is not ``INVALID`` (a null label is kept, as in the
    original tool)."""
    return df.where(~F.col(LABEL).eqNullSafe(F.lit(INVALID_LABEL)))


def _pct(n: Column, total: Column) -> Column:
    # evaluation order of the original: n / total * 100, 0 for an empty table
    return F.when(total > 0, (n.cast("double") / total.cast("double")) * F.lit(100.0)).otherwise(F.lit(0.0))


def category_counts(df: DataFrame) -> DataFrame:
    """A2: rows per label over valid rows, any label that occurs, nulls dropped,
    largest first (ties by label)."""
    return (
        valid_only(df)
        .where(F.col(LABEL).isNotNull())
        .groupBy(F.col(LABEL).alias("label"))
        .agg(F.count(F.lit(1)).cast("long").alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
    )


def category_counts_json(df: DataFrame) -> DataFrame:
    """F8: the category counts as one JSON object (label -> n, keys sorted), the
    form in which they feed a report or a model prompt. The aggregate has one
    row per label, so the final one-group collect is small."""
    return category_counts(df).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))).alias("counts_json")
    )


def category_cards(df: DataFrame, categories=CATEGORIES) -> DataFrame:
    """A3 (+J3): n and percent of valid rows for each fixed category, 0 when
    absent. One aggregate pass, then the one-row result is unpivoted; no join."""
    lab = F.col(LABEL)
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(lab == F.lit(c)).alias(f"_c{i}") for i, c in enumerate(categories)]
    one = valid_only(df).agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("long").alias("ordinal"),
            F.lit(c).alias("category"),
            F.col(f"_c{i}").cast("long").alias("n"),
        )
        for i, c in enumerate(categories)
    ])
    return (
        one.select(F.col("_total"), F.inline(rows))
        .withColumn("pct", _pct(F.col("n"), F.col("_total")))
        .drop("_total")
    )


def results_header(df: DataFrame, threshold: float = LOW_CONFIDENCE_DEFAULT) -> DataFrame:
    """A4, A9, A10 (+S4 row total): one aggregate pass over the classified listing."""
    lab = F.col(LABEL)
    valid = ~lab.eqNullSafe(F.lit(INVALID_LABEL))
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.count_if(valid).cast("long").alias("n_classified"),
        F.count_if(valid & (F.col(CONFIDENCE) < F.lit(threshold))).cast("long").alias("n_low_confidence"),
        F.count_if(lab == F.lit("Medically Related")).cast("long").alias("n_medical"),
    )


def top_items(
    df: DataFrame,
    cols: ListingColumns = DEFAULT_COLUMNS,
    label: str = "Confused",
    k: int = TOP_ITEMS_SUMMARY,
) -> DataFrame:
    """A5/A6 (+L1, L2): the ``k`` items with most rows of ``label``, ties by item.
    Planned as partial aggregate -> exchange -> take-ordered (no full sort)."""
    return (
        valid_only(df)
        .where((F.col(LABEL) == F.lit(label)) & named(cols.item).isNotNull())
        .groupBy(named(cols.item).alias("item"))
        .agg(F.count(F.lit(1)).cast("long").alias("n"))
        .orderBy(F.desc("n"), F.asc("item"))
        .limit(k)
    )


def confidence_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``bins`` equal-width bins from min to max, right-closed, the lowest
    value in bin 1, empty bins kept, nulls dropped.

    Values are first counted per distinct confidence (partial aggregation).
    The range and all edges come from one 1-row aggregate over that table,
    used as a single scalar subquery (no join with the data, no driver round
    trip). Edges are ``min + i * (range / bins)``, the first lowered by 0.1 %
    of the range; a single value is widened by 0.1 % on each side (0.001 when
    it is 0), without the lowering.
    """
    spark = df.sparkSession
    c = F.col(CONFIDENCE)
    vc = (
        valid_only(df).where(c.isNotNull() & ~F.isnan(c))
        .groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    )
    raw = vc.agg(F.min("v").alias("mn0"), F.max("v").alias("mx0"))
    mn0, mx0 = F.col("mn0"), F.col("mx0")
    same = mn0 == mx0

    def widen(x: Column, sign: float) -> Column:
        return F.when(x == 0, F.lit(sign * 0.001)).otherwise(x + F.lit(sign * 0.001) * F.abs(x))

    st = raw.select(
        F.when(same, widen(mn0, -1.0)).otherwise(mn0).alias("mn"),
        F.when(same, widen(mx0, 1.0)).otherwise(mx0).alias("mx"),
        same.alias("same"),
    )
    mn, mx = F.col("mn"), F.col("mx")
    width = (mx - mn) / F.lit(float(bins))
    inner = [mn + F.lit(float(i)) * width for i in range(1, bins)]
    first = F.when(F.col("same"), mn).otherwise(mn - (mx - mn) * F.lit(0.001))
    stats = st.select(
        F.struct(
            F.array(*inner).alias("inner"),
            F.array(first, *inner, mx).alias("edges"),
        ).alias("s")
    ).where(F.col("s.edges")[0].isNotNull())
    s = stats.scalar()  # one subquery, referenced once per side below

    counted = (
        vc.withColumn("_s", s)
        .groupBy(
            (F.lit(1) + F.size(F.filter(F.col("_s.inner"), lambda e: F.col("v") > e))).cast("long").alias("bin")
        )
        .agg(F.sum("cnt").cast("long").alias("n"))
    )
    b = F.col("bin")
    frame = spark.range(1, bins + 1).select(F.col("id").alias("bin")).withColumn("_s", s)
    return (
        frame.where(F.col("_s").isNotNull())
        .join(counted, "bin", "left")
        .select(
            b,
            F.col("_s.edges")[(b - 1).cast("int")].alias("lo"),
            F.col("_s.edges")[b.cast("int")].alias("hi"),
            F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        )
        .orderBy("bin")  # ``bins`` rows
    )


def study_category_pivot(
    df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, categories=CATEGORIES
) -> DataFrame:
    """One row per study, one count column per category (0 when absent),
    null studies and labels dropped. Values are given, so no extra job to find them."""
    return (
        valid_only(df)
        .where(named(cols.study).isNotNull() & F.col(LABEL).isNotNull())
        .groupBy(named(cols.study).alias("study"))
        .pivot(LABEL, list(categories))
        .agg(F.count(F.lit(1)))
        .na.fill(0, subset=list(categories))
        .select("study", *[F.col(f"`{c}`").cast("long").alias(c) for c in categories])
    )


def study_category_counts(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS) -> DataFrame:
    """A8, long form: (study, label, n)."""
    return (
        valid_only(df)
        .where(named(cols.study).isNotNull() & F.col(LABEL).isNotNull())
        .groupBy(named(cols.study).alias("study"), F.col(LABEL).alias("label"))
        .agg(F.count(F.lit(1)).cast("long").alias("n"))
    )


def summary_bundle(
    df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, k: int = TOP_ITEMS_SUMMARY
) -> DataFrame:
    """The numbers of the run summary as one table
    ``(section, rank, key, n, pct)``: total classified (A9), rows per label
    (A2) and the top-``k`` items among confused rows (A5)."""
    cc = category_counts(df)
    # the valid-row total as a scalar subquery: no join with the data
    total = valid_only(df).agg(F.count(F.lit(1)).cast("long")).scalar()
    # Windows below run over results of at most a few rows (labels, top-k).
    w_lab = Window.orderBy(F.desc("n"), F.asc("label"))
    labels = cc.select(
        F.lit("category").alias("section"),
        F.row_number().over(w_lab).cast("long").alias("rank"),
        F.col("label").alias("key"),
        F.col("n"),
        _pct(F.col("n"), total).alias("pct"),
    )
    items = top_items(df, cols, "Confused", k)
    w_it = Window.orderBy(F.desc("n"), F.asc("item"))
    items = items.select(
        F.lit("confused_item").alias("section"),
        F.row_number().over(w_it).cast("long").alias("rank"),
        F.col("item").alias("key"),
        F.col("n"),
        _pct(F.col("n"), total).alias("pct"),
    )
    tot = df.sparkSession.range(1).select(
        F.lit("total").alias("section"), F.lit(0).cast("long").alias("rank"),
        F.lit(None).cast("string").alias("key"), total.alias("n"),
        F.lit(None).cast("double").alias("pct"),
    )
    return tot.unionByName(labels).unionByName(items)


def confusion_alerts(
    df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, rate: float = CONFUSION_ALERT_RATE
) -> DataFrame:
    """Confused share of valid rows, overall and per study; ``alert`` when
    it exceeds ``rate`` (strict). Uses grouping sets: one pass, one shuffle."""
    v = valid_only(df)
    conf = F.count_if(F.col(LABEL) == F.lit("Confused")).cast("long")
    g = v.rollup(named(cols.study).alias("study")).agg(
        F.count(F.lit(1)).cast("long").alias("n_valid"),
        conf.alias("n_confused"),
        F.grouping_id().alias("_gid"),
    )
    g = g.where((F.col("_gid") == 1) | F.col("study").isNotNull())
    # an empty listing has an overall row with 0 valid rows: no rate (and no
    # division by zero under ANSI mode)
    r = F.when(F.col("n_valid") > 0, F.col("n_confused").cast("double") / F.col("n_valid").cast("double"))
    return g.select(
        F.when(F.col("_gid") == 1, F.lit("overall")).otherwise(F.lit("study")).alias("scope"),
        "study", "n_valid", "n_confused",
        r.alias("confused_rate"),
        (r > F.lit(rate)).alias("alert"),
    )


def site_confusion(
    df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, min_rows: int = 5
) -> DataFrame:
    """Per site, valid rows, confused rows and rate; sites with fewer than
    ``min_rows`` valid rows are left out."""
    g = (
        valid_only(df).where(named(cols.site).isNotNull())
        .groupBy(named(cols.site).alias("site"))
        .agg(
            F.count(F.lit(1)).cast("long").alias("n_valid"),
            F.count_if(F.col(LABEL) == F.lit("Confused")).cast("long").alias("n_confused"),
        )
        .where(F.col("n_valid") >= F.lit(min_rows))
    )
    return g.withColumn("confused_rate", F.col("n_confused").cast("double") / F.col("n_valid").cast("double"))


def alert_report(df: DataFrame, cols: ListingColumns = DEFAULT_COLUMNS, rate: float = CONFUSION_ALERT_RATE,
                 k: int = TOP_ITEMS_SUMMARY) -> DataFrame:
    """D1, what an alert says: (section, scope, study, rank, key, n, pct, alert), sections

    * ``total``: valid rows and confused share, overall and for each study (``alert``: the share exceeds ``rate``);
    * ``breakdown``: rows for each label, overall and for each study;
    * ``top_item``: the ``k`` items with most confused rows, overall and for each study.

    The listing is read once: rows for each (study, item, label) are counted with partial sums,
    and that small table, stored, gives every section. The best items are cut to ``k`` for each task before
    they move. Rows without a study count overall only, rows without an item in no item list."""
    study, item = named(cols.study).alias("study"), named(cols.item).alias("item")
    counted = valid_only(df).groupBy(study, item, F.col(LABEL).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    counted = stage(counted, "alert-counts")
    scopes = F.when(F.col("study").isNull(), F.array(F.struct(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("of")))).otherwise(
        F.array(F.struct(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("of")), F.struct(F.lit("study").alias("scope"), F.col("study").alias("of"))))
    each = counted.withColumn("at", F.explode(scopes)).select("at.scope", F.col("at.of").alias("study"), "item", "label", "n")
    confused = F.col("label") == F.lit("Confused")

    total = each.groupBy("scope", "study").agg(F.sum("n").alias("all"), F.sum(F.when(confused, F.col("n")).otherwise(0)).alias("n"))
    of_total = total.select("scope", "study", "all")
    out = ["section", "scope", "study", "rank", "key", "n", "pct", "alert"]

    def shaped(rows: DataFrame, section: str, rank: Column, key: Column, alert: Column) -> DataFrame:
        named_rows = rows.select(F.lit(section).alias("section"), "scope", "study", rank.cast("long").alias("rank"), key.alias("key"),
                                 F.col("n").cast("long").alias("n"), _pct(F.col("n"), F.col("all")).alias("pct"), alert.alias("alert"))
        return named_rows.select(*out)

    def ranked(rows: DataFrame, key: str) -> Column:
        return F.row_number().over(Window.partitionBy("scope", "study").orderBy(F.desc("n"), F.asc(key)))

    def with_total(rows: DataFrame) -> DataFrame:
        t = of_total.select(F.col("scope").alias("_s"), F.col("study").alias("_t"), "all")
        return rows.join(t, (F.col("scope") == F.col("_s")) & F.col("study").eqNullSafe(F.col("_t")))

    none = F.lit(None)
    share = F.col("n").cast("double") / F.col("all").cast("double")
    totals = shaped(total, "total", F.lit(0), none.cast("string"), share > F.lit(rate))
    labels = with_total(each.where(F.col("label").isNotNull()).groupBy("scope", "study", "label").agg(F.sum("n").alias("n")))
    labels = shaped(labels.withColumn("_r", ranked(labels, "label")), "breakdown", F.col("_r"), F.col("label"), none.cast("boolean"))
    items = each.where(confused & F.col("item").isNotNull()).groupBy("scope", "study", "item").agg(F.sum("n").alias("n"))
    items = with_total(items.withColumn("_r", ranked(items, "item")).where(F.col("_r") <= k))
    items = shaped(items, "top_item", F.col("_r"), F.col("item"), none.cast("boolean"))
    return totals.unionByName(labels).unionByName(items)


def consistently_confused_sites(df: DataFrame, period: Column, cols: ListingColumns = DEFAULT_COLUMNS,
                                rate: float = CONFUSION_ALERT_RATE, runs: int = 3, min_rows: int = 1) -> DataFrame:
    """D2 over time: runs of ``runs`` or more consecutive periods in which a site's confused share
    of valid rows exceeds ``rate``: (site, first_period, last_period, n_periods, n_valid, n_confused).

    ``period``: a whole number that grows by one from a period to the next. A period without
    ``min_rows`` valid rows ends a run. Rows are counted for each site and period with partial sums; what the
    window then sees is one row for each site and period over the rate."""
    confused = F.count_if(F.col(LABEL) == F.lit("Confused"))
    g = (
        valid_only(df).where(named(cols.site).isNotNull())
        .groupBy(named(cols.site).alias("site"), period.cast("long").alias("period"))
        .agg(F.count(F.lit(1)).alias("n_valid"), confused.alias("n_confused"))
        .where(F.col("period").isNotNull() & (F.col("n_valid") >= min_rows)
               & (F.col("n_confused").cast("double") / F.col("n_valid").cast("double") > F.lit(rate)))
    )
    # consecutive periods keep their distance to their rank
    island = F.col("period") - F.row_number().over(Window.partitionBy("site").orderBy("period"))
    return (
        g.withColumn("_island", island).groupBy("site", "_island")
        .agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).cast("long").alias("n_periods"),
             F.sum("n_valid").cast("long").alias("n_valid"), F.sum("n_confused").cast("long").alias("n_confused"))
        .where(F.col("n_periods") >= runs).drop("_island")
    )

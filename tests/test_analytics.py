"""Aggregates, the histogram against pandas, empty/absent cases."""

import numpy as np
import pandas as pd
import pytest
import random
from collections import Counter

from pyspark.sql import types as T

from replysift.operators import analytics as an

SCHEMA = T.StructType([
    T.StructField("Query ID", T.StringType()), T.StructField("Study Alias", T.StringType()),
    T.StructField("Site", T.StringType()), T.StructField("CRF Item", T.StringType()),
    T.StructField("LLM_Classification", T.StringType()), T.StructField("Confidence", T.DoubleType()),
])


def classified(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    ("1", "A", "s1", "AE", "Confused", 0.95), ("2", "A", "s1", "AE", "Confused", 0.6),
    ("3", "B", "s2", "VS", "Confused", 0.3), ("4", "B", "s2", "VS", "Affirmative", 0.95),
    ("5", None, "s2", None, "Confused", 0.5), ("6", "A", "s1", "LB", "INVALID", None),
    ("7", "A", "s1", "LB", None, 0.9), ("8", "B", "s3", "LB", "Other", 0.1),
]


@pytest.mark.parametrize("values", [
    [0.95, 0.6, 0.3, 0.95, 0.5, 0.9, 0.1],
    [0.5, 0.5, 0.5],
    [0.0, 0.0],
    [-2.0, 3.0, 0.25, 0.25, 1.0],
    [0.3 + 0.65 * k / 7 for k in range(8)],
    list(np.linspace(0, 1, 21)),
])
def test_histogram_matches_pandas(spark, values):
    rows = [(str(i), "A", "s", "x", "Miscellaneous", float(v)) for i, v in enumerate(values)]
    rows.append(("n", "A", "s", "x", "Miscellaneous", None))
    got = an.confidence_histogram(classified(spark, rows)).collect()
    vc = pd.Series([r[5] for r in rows]).dropna().value_counts(bins=10).sort_index()
    assert [r.n for r in got] == list(vc.values)
    # pandas rounds its interval labels for display; compare with the exact edges it bins by
    vals = pd.Series([r[5] for r in rows]).dropna()
    mn, mx = vals.min(), vals.max()
    if mn == mx:
        mn = mn - 0.001 * abs(mn) if mn != 0 else mn - 0.001
        mx = mx + 0.001 * abs(mx) if mx != 0 else mx + 0.001
        edges = np.linspace(mn, mx, 11)
    else:
        edges = np.linspace(mn, mx, 11)
        edges[0] -= (mx - mn) * 0.001
    _, exact = pd.cut(vals, edges, retbins=True, include_lowest=True)
    assert [r.lo for r in got] == list(exact[:-1])
    assert [r.hi for r in got] == list(exact[1:])
    assert [round(r.lo, 3) for r in got][1:] == [round(iv.left, 3) for iv in vc.index][1:]


def test_histogram_empty(spark):
    rows = [("1", "A", "s", "x", "INVALID", None)]
    assert an.confidence_histogram(classified(spark, rows)).count() == 0


def test_counts_cards_header(spark):
    df = classified(spark, ROWS)
    cc = {r.label: r.n for r in an.category_counts(df).collect()}
    assert cc == {"Confused": 4, "Affirmative": 1, "Other": 1}
    cards = {r.category: (r.n, r.pct) for r in an.category_cards(df).collect()}
    assert cards["Confused"] == (4, 4 / 7 * 100) and cards["Medically Related"] == (0, 0.0)
    h = an.results_header(df).first()
    assert (h.n_rows, h.n_classified, h.n_low_confidence, h.n_medical) == (8, 7, 4, 0)


def test_cards_empty_table(spark):
    cards = an.category_cards(classified(spark, [("1", "A", "s", "x", "INVALID", None)])).collect()
    assert [(r.n, r.pct) for r in cards] == [(0, 0.0)] * 4


def test_top_items_ties_and_nulls(spark):
    got = [(r.item, r.n) for r in an.top_items(classified(spark, ROWS), k=10).collect()]
    assert got == [("AE", 2), ("VS", 1)]
    assert an.top_items(classified(spark, ROWS), k=1).count() == 1


def test_pivot_and_alerts(spark):
    df = classified(spark, ROWS)
    p = {r.study: r.asDict() for r in an.study_category_pivot(df).collect()}
    assert set(p) == {"A", "B"}
    assert p["A"]["Confused"] == 2 and p["B"]["Affirmative"] == 1 and p["A"]["Medically Related"] == 0
    al = {(r.scope, r.study): (r.n_valid, r.n_confused, r.alert) for r in an.confusion_alerts(df).collect()}
    assert al[("overall", None)] == (7, 4, True)
    assert al[("study", "A")] == (3, 2, True)
    site = {r.site: r.n_valid for r in an.site_confusion(df, min_rows=2).collect()}
    assert site == {"s1": 3, "s2": 3}


def test_summary_bundle(spark):
    b = an.summary_bundle(classified(spark, ROWS)).collect()
    tot = [r for r in b if r.section == "total"][0]
    assert tot.n == 7
    cats = [(r.rank, r.key, r.n) for r in b if r.section == "category"]
    assert cats[0] == (1, "Confused", 4)
    assert sum(r.n for r in b if r.section == "category") == 6   # null label dropped


def test_empty_listing_has_no_alert_rows(spark):
    # no valid rows: the grouping sets produce no row at all (no rate, no division by zero)
    assert an.confusion_alerts(classified(spark, [("1", "A", "s", "x", "INVALID", None)])).count() == 0


def classified_table(spark, rows):
    return spark.createDataFrame(rows, "row_key string, `Study Alias` string, Site string, `CRF Item` string, LLM_Classification string, day int")


def test_alert_report_sections(spark):
    from replysift.operators.analytics import alert_report

    rng = random.Random(4)
    rows = [(str(i), rng.choice(["A", "B", None]), "s", rng.choice(["x", "y", "z", "w", None]),
             rng.choice(["Confused", "Affirmative", "INVALID", None]), 0) for i in range(300)]
    got = {}
    for r in alert_report(classified_table(spark, rows), k=2).collect():
        got.setdefault((r.section, r.scope, r.study), []).append((r["rank"], r.key, r.n, round(r.pct, 9), r.alert))
    for scope, study in (("overall", None), ("study", "A"), ("study", "B")):
        mine = [r for r in rows if r[4] != "INVALID" and (study is None or r[1] == study)]
        confused = [r for r in mine if r[4] == "Confused"]
        share = len(confused) / len(mine)
        assert got["total", scope, study] == [(0, None, len(confused), round(share * 100, 9), share > 0.3)]
        labels = sorted(Counter(r[4] for r in mine if r[4]).items(), key=lambda x: (-x[1], x[0]))
        assert sorted(got["breakdown", scope, study]) == [(i, k, n, round(n / len(mine) * 100, 9), None) for i, (k, n) in enumerate(labels, 1)]
        items = sorted(Counter(r[3] for r in confused if r[3]).items(), key=lambda x: (-x[1], x[0]))[:2]
        assert sorted(got["top_item", scope, study]) == [(i, k, n, round(n / len(mine) * 100, 9), None) for i, (k, n) in enumerate(items, 1)]
    assert alert_report(classified_table(spark, [])).count() == 0


def test_runs_of_confused_periods(spark):
    from pyspark.sql import functions as F

    from replysift.operators.analytics import consistently_confused_sites

    def day(site, d, confused, others):
        return [(f"{site}{d}{i}", "A", site, "x", "Confused" if i < confused else "Affirmative", d) for i in range(confused + others)]

    rows = [r for d in (1, 2, 3, 5, 6, 7, 8) for r in day("p", d, 2, 1)] + day("p", 4, 0, 5)
    rows += [r for d in (1, 2, 4) for r in day("q", d, 3, 0)] + [r for d in (1, 2, 3) for r in day("r", d, 3, 7)]
    rows += [(f"n{i}", "A", None, "x", "Confused", i) for i in range(5)] + [("u", "A", "q", "x", "Confused", None)]
    out = consistently_confused_sites(classified_table(spark, rows), F.col("day"), rate=0.3, runs=3)
    assert sorted(tuple(r) for r in out.collect()) == [("p", 1, 3, 3, 9, 6), ("p", 5, 8, 4, 12, 8)]
    strict = consistently_confused_sites(classified_table(spark, rows), F.col("day"), rate=0.3, runs=2, min_rows=4)
    assert strict.count() == 0


def test_exact_sample_is_exact_and_layout_free(spark):
    import hashlib

    from replysift.operators import filters as fl

    rows = [(f"k{i}", "A" if i % 3 else ("B" if i % 2 else None), "s", "x", "Confused", 0) for i in range(3000)] + [("only", "C", "s", "x", "Confused", 0)]
    df = classified_table(spark, rows)

    def draw(k):
        return int(hashlib.md5(f"7|{k}".encode()).hexdigest()[:8], 16), k

    for n in (0, 1, 25, 700):
        want = set()
        for study in ("A", "B", "C", None):
            want |= set(sorted((r[0] for r in rows if r[1] == study), key=draw)[:n])
        for parts in (1, 9):
            got = [r.row_key for r in fl.exact_sample(df.repartition(parts), n, "Study Alias").collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert {r.row_key for r in fl.exact_sample(df, 5).collect()} == set(sorted((r[0] for r in rows), key=draw)[:5])
    assert fl.exact_sample(df, 5).columns == df.columns


def test_column_fill(spark):
    from replysift.sources.listing import column_fill

    df = spark.createDataFrame([("1", "a", None), ("2", None, None)], "`Query ID` string, `Site Response` string, Site string")
    got = {r.role: (r.column, r.present, r.n_filled, r.n_rows) for r in column_fill(df).collect()}
    assert got["response"] == ("Site Response", True, 1, 2) and got["site"] == ("Site", True, 0, 2)
    assert got["item"] == ("CRF Item", False, 0, 2) and len(got) == 6

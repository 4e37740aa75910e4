"""Differential check: every registered query against its DuckDB SQL twin (sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from replysift.plans.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(round(x, 9))
        return repr(x)

    return sorted("\x1f".join(v(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_of_the_listing_part_has_an_oracle():
    from replysift.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "n"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert norm(srows, sdf.columns) == norm(drows, dcols)


def test_no_plan_repeats_the_scoring(spark):
    """The text scan stands in a plan once, whatever an analytic does with its result."""
    from replysift.plans.queries import QUERIES

    for name in ("study_category_pivot_lineitem", "confidence_histogram_lineitem", "category_counts", "filtered_rows", "alert_report",
                 "classify_documents", "classify_lineitem", "summary_bundle", "consistent_sites"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= 1, name
    validated = QUERIES["validate_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert validated.count("FileScan") <= 2

"""Classified listing shape, stamps, invariants, partition independence."""

import pytest
from pyspark.sql import functions as F

from conftest import listing
from replysift.config import CATEGORIES, OUTPUT_COLUMNS
from replysift.operators.classify import classify, validate, validity_counts

RESP = ["done", None, "", "How do I enter this?", "12.5", "patient hospitalized", "see attached",
        " N/A", "nan", "Updated"]


def test_output_columns_and_stamps(spark):
    df = listing(spark, RESP, extra={"Site": ["s1"] * len(RESP)})
    out = classify(df)
    assert out.columns == df.columns + list(OUTPUT_COLUMNS)
    rows = {r["Query ID"]: r for r in out.collect()}
    inv = rows["1"]
    assert (inv.Is_Valid, inv.LLM_Classification, inv.Confidence, inv.Reasoning, inv.Human_Reviewed) == (
        False, "INVALID", None, "Empty or invalid response", False)
    assert rows["0"].LLM_Classification == "Affirmative"
    assert rows["3"].LLM_Classification == "Confused"
    assert rows["5"].LLM_Classification == "Medically Related"
    assert rows["6"].LLM_Classification == "Miscellaneous"
    assert rows["7"].Is_Valid is True                  # padded N/A survives
    assert rows["4"].LLM_Classification == "INVALID"


def test_invariants(spark):
    df = listing(spark, RESP * 20)
    out = classify(df)
    labels = {r[0] for r in out.select("LLM_Classification").distinct().collect()}
    assert labels <= set(CATEGORIES) | {"INVALID"}
    c = validity_counts(validate(df)).first()
    assert c.n_valid + c.n_invalid == c.n_total == df.count()
    assert out.where("Is_Valid").count() == c.n_valid


def test_partition_independence(spark):
    df = listing(spark, RESP * 30, ids=[str(i) for i in range(len(RESP) * 30)])
    a = sorted(tuple(r) for r in classify(df.repartition(1)).collect())
    b = sorted(tuple(r) for r in classify(df.repartition(7)).collect())
    assert a == b


def test_missing_response_column_raises(spark):
    df = spark.createDataFrame([("1", "done")], "`Query ID` string, Response string")
    with pytest.raises(ValueError):
        classify(df)


def test_output_column_collision_raises(spark):
    df = listing(spark, ["done"], extra={"Confidence": ["high"]})
    with pytest.raises(ValueError):
        classify(df)


def test_single_narrow_pass(spark):
    out = classify(listing(spark, RESP))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                      # row-local: no shuffle
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no Python
    assert F is not None

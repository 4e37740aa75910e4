"""Input order: the same positions however the reader cuts the files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from replysift.operators.classify import classify
from replysift.operators.filters import input_export_positions
from replysift.sources.listing import normalise_null_tokens
from replysift.sources.places import input_positions, with_place
from replysift.sources.sinks import stage

ANSWERS = ["done", "", "why?", "patient ok", "N/A", "12"]


def expected(rows):
    valid = [k for k, a in rows if a in ("done", "why?", "patient ok")]
    invalid = [k for k, a in rows if a not in ("done", "why?", "patient ok")]
    return {k: i for i, k in enumerate(valid + invalid)}


@pytest.mark.parametrize("split_bytes", ["128m", "700b", "64b"])
def test_positions_do_not_depend_on_splits(spark, tmp_dir, split_bytes):
    rng = random.Random(3)
    rows = []
    for part in range(3):  # keys in no order; files of different sizes, read side by side
        with open(os.path.join(tmp_dir, f"p{part}.csv"), "w") as f:
            f.write("Query ID,CRF Item,Site Response\n")
            for _ in range(40 + 90 * part):
                key, answer = f"{part}-{rng.randrange(10**9)}", rng.choice(ANSWERS)
                rows.append((key, answer))
                f.write(f"{key},item,{answer}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scan = spark.read.option("header", True).csv(tmp_dir)
        placed = stage(classify(normalise_null_tokens(with_place(scan))), "placed")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert placed.select("_place.file", "_place.split").distinct().count() >= {"128m": 3, "700b": 8, "64b": 50}[split_bytes]
    out = input_export_positions(placed)
    assert {r["Query ID"]: r.row_pos for r in out.collect()} == expected(rows)
    assert out.columns == [*placed.columns, "row_pos"]


def test_parts_nulls_and_empty_table(spark, tmp_dir):
    spark.range(100).select("id", F.when(F.col("id") % 3 != 0, F.col("id") % 2 == 0).alias("even")).repartitionByRange(4, "id").write.parquet(tmp_dir + "/t")
    placed = stage(with_place(spark.read.parquet(tmp_dir + "/t")), "placed")
    out = input_positions(placed, [F.col("even"), F.col("id") > 50])
    got = [r.id for r in out.orderBy("row_pos").collect()]
    first = [i for i in range(100) if i % 3 and i % 2 == 0]
    second = [i for i in range(51, 100) if i not in first]
    assert got == first + second + [i for i in range(100) if i not in first + second]
    assert [r.row_pos for r in out.orderBy("row_pos").collect()] == list(range(100))
    assert input_positions(placed.where("id < 0")).count() == 0


def test_no_sort_over_the_table(spark, tmp_dir):
    spark.range(50).write.parquet(tmp_dir + "/t")
    placed = stage(with_place(spark.read.parquet(tmp_dir + "/t")), "placed")
    plan = input_positions(placed)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    # the one window without partitions sees a row for each split
    assert plan.count("SinglePartition") == 1

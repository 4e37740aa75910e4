"""Versioned tables, the listing stored by label, and the life of stage folders."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import listing
from replysift.operators.classify import classify
from replysift.operators.review import apply_corrections
from replysift.sources.label_table import LabelTable
from replysift.sources.listing import with_row_key
from replysift.sources.sinks import new_stage_path, stage, stage_scope
from replysift.sources.snapshots import Snapshots


def test_snapshots_replace_and_replay(spark, tmp_dir):
    table = Snapshots(spark, tmp_dir + "/t")
    assert table.current() is None and table.read() is None
    assert table.write(spark.range(3).toDF("x"), 0)
    held = table.read()
    assert table.write(table.read().select((F.col("x") + 10).alias("x")), 1)  # reads what it replaces
    assert sorted(r.x for r in table.read().collect()) == [10, 11, 12]
    assert not table.write(spark.range(1).toDF("x"), 1) and not table.write(spark.range(1).toDF("x"), 0)
    assert table.read().count() == 3 and held.count() == 3  # the epoch before is still there
    table.write(spark.range(5).toDF("x"), 2)
    assert table.epochs() == [1, 2] and not os.path.exists(tmp_dir + "/t/epoch=0")


def test_half_written_epoch_is_not_read(spark, tmp_dir):
    table = Snapshots(spark, tmp_dir + "/t")
    table.write(spark.range(3).toDF("x"), 0)

    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("x"))
    with pytest.raises(Exception, match="lost"):
        table.write(broken, 1)
    spark.range(9).toDF("x").limit(1).write.mode("overwrite").parquet(tmp_dir + "/t/epoch=1")  # left by a writer that died
    assert table.current() == 0 and table.read().count() == 3
    assert table.write(spark.range(7).toDF("x"), 1) and table.read().count() == 7


def classified_rows(spark, n=60):
    rng = random.Random(1)
    answers = [rng.choice(["done", "why?", "patient has pain", "next week", "", "12"]) for _ in range(n)]
    return classify(with_row_key(listing(spark, answers), id_col="Query ID"))


def files_of(root):
    out = {}
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".parquet") and "rows-" in folder:
                path = os.path.join(folder, n)
                out[path] = os.stat(path).st_mtime_ns
    return out


def same_rows(a, b):
    columns = sorted(b.columns)
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def test_merge_rewrites_only_touched_labels(spark, tmp_dir):
    df = classified_rows(spark)
    rows = {r.row_key: r.LLM_Classification for r in df.collect()}
    table = LabelTable(spark, tmp_dir + "/t")
    table.create(df)
    before = files_of(tmp_dir)
    confused = [k for k, v in rows.items() if v == "Confused"][:2]
    invalid = [k for k, v in rows.items() if v == "INVALID"][:1]
    fix = spark.createDataFrame([(confused[0], "Miscellaneous", 1), (confused[1], "Affirmative", 5), (confused[1], "Miscellaneous", 7),
                                 (invalid[0], "Affirmative", 1), ("nobody", "Confused", 1)], "row_key string, corrected_label string, seq long")
    assert table.merge(fix) == ["confused", "miscellaneous"]
    want = apply_corrections(df, fix)
    assert same_rows(table.read(), want)
    after = files_of(tmp_dir)
    kept = {p: t for p, t in before.items() if "part=confused" not in p and "part=miscellaneous" not in p}
    assert kept and all(after.get(p) == t for p, t in kept.items())
    assert table.merge(fix) == [] and files_of(tmp_dir) == after  # the same corrections again
    more = spark.createDataFrame([(confused[0], "Confused", 9)], "row_key string, corrected_label string, seq long")
    assert table.merge(more) == ["confused", "miscellaneous"]
    assert same_rows(table.read(), apply_corrections(want, more))
    with pytest.raises(ValueError, match="already"):
        table.create(df)


def test_reader_keeps_its_version_and_old_folders_go(spark, tmp_dir):
    df = classified_rows(spark)
    table = LabelTable(spark, tmp_dir + "/t", keep=1)
    table.create(df)
    keys = [r.row_key for r in df.where("LLM_Classification = 'Affirmative'").collect()]
    for seq, label in enumerate(["Confused", "Affirmative", "Confused"]):
        table.merge(spark.createDataFrame([(k, label, seq) for k in keys], "row_key string, corrected_label string, seq long"))
    folders = {n for n in os.listdir(tmp_dir + "/t") if n.startswith("rows-")}
    assert folders == {f"rows-{n}" for _, n in table.parts()}
    assert table.read().count() == df.count()


def test_labels_outside_the_categories_share_a_part(spark, tmp_dir):
    df = classified_rows(spark, 12).withColumn("LLM_Classification", F.when(F.col("Is_Valid"), F.concat(F.lit("own "), F.col("row_key"))))
    table = LabelTable(spark, tmp_dir + "/t")
    table.create(df)
    assert [p for p, _ in table.parts()] == ["other"] and table.read().count() == 12


def test_stage_scope_removes_what_results_do_not_read(spark):
    paths = []

    def staged(df, name):
        out = stage(df, name)
        paths.append(out.inputFiles()[0].split(":", 1)[1].rsplit("/", 1)[0])
        return out

    with stage_scope(spark) as scope:
        a = staged(spark.range(10).toDF("x"), "a")
        b = staged(a.where("x > 3"), "b")
        with stage_scope(spark):
            staged(spark.range(3).toDF("x"), "c")
        assert not os.path.exists(paths[2])
        result = scope.keep(b.groupBy().sum("x"))
    assert [os.path.exists(p.replace("//", "/")) for p in paths] == [False, True, False]
    assert result.first()[0] == sum(range(4, 10))
    scope.remove_stages(kept_too=True)
    assert not os.path.exists(paths[1])
    with pytest.raises(RuntimeError), stage_scope(spark) as scope:
        scope.keep(staged(spark.range(3).toDF("x"), "d"))
        raise RuntimeError
    assert not os.path.exists(paths[3]) and new_stage_path(spark, "e")


def test_registered_query_leaves_only_what_it_reads(spark):
    from replysift.plans.queries import QUERIES
    from replysift.sources.sinks import stage_root

    root = stage_root(spark) + "/replysift"
    root = root.split(":", 1)[1] if root.startswith("file:") else root
    before = set(os.listdir(root)) if os.path.exists(root) else set()
    out = QUERIES["stream_category_counts"](spark, "/root/testdata/sf0.001")
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before}
    assert left == {"stream-counts"} and out.count() > 2

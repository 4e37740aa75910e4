"""Row identity: id keys, content keys with a hot group of copies spread over partitions."""

import hashlib

from pyspark.sql import functions as F

from replysift.sources.listing import is_unique, with_row_key


def test_hot_copies_get_unique_keys_equal_to_plain_numbering(spark):
    rows = [("x", "same")] * 300 + [(f"k{i}", f"v{i % 7}") for i in range(600)] + [("y", None)] * 5
    df = spark.createDataFrame(rows, "a string, b string").repartition(12)
    keyed = with_row_key(df, salts=4)
    keys = [r.row_key for r in keyed.collect()]
    assert len(keys) == len(set(keys)) == len(rows)

    def fp(a, b):
        parts = [("N" if v is None else "V" + v) for v in (a, b)]
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()

    expected, seen = [], {}
    for a, b in rows:
        h = fp(a, b)
        seen[h] = seen.get(h, 0) + 1
        expected.append(f"{h}-{seen[h]}")
    assert sorted(keys) == sorted(expected)


def test_id_key_and_uniqueness_check(spark):
    df = spark.createDataFrame([("1",), ("2",), ("2",)], "id string")
    assert not is_unique(df, "id")
    assert is_unique(df.distinct(), "id")
    assert with_row_key(df, id_col="id").select(F.col("row_key")).distinct().count() == 3


def test_shared_and_missing_ids_get_content_keys(spark):
    rows = [("1", "a"), ("2", "b"), ("2", "c"), ("2", "c"), (None, "d"), (None, "d"), ("3", None)]
    df = spark.createDataFrame(rows, "id string, v string").repartition(4)
    keys = {}
    for r in with_row_key(df, id_col="id").collect():
        keys.setdefault((r.id, r.v), []).append(r.row_key)
    assert keys["1", "a"] == ["1"] and keys["3", None] == ["3"]
    flat = [k for v in keys.values() for k in v]
    assert len(set(flat)) == len(rows) and all(k.startswith("#") for k in keys["2", "c"] + keys[None, "d"] + keys["2", "b"])


def test_default_salt_on_shuffled_and_coalesced_input(spark):
    df = spark.range(4000).selectExpr("id % 5 AS a", "cast(id % 40 AS string) AS b")
    for shuffled in (df.repartition(9), df.repartition("b"), df.groupBy("a", "b").count().drop("count").union(df.select("a", "b"))):
        keyed = with_row_key(shuffled)
        assert keyed.select("row_key").distinct().count() == shuffled.count()


def test_property_keys_and_export_positions(spark):
    """Random listings with many exact copies, random partition and salt counts:
    keys equal plain per-fingerprint numbering, and export positions are the
    dense 0..n-1 ranks of (valid first, row key)."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    from replysift.operators.classify import classify
    from replysift.operators.filters import export_positions

    answer = st.sampled_from(["done", "", "How?", "12.5", "patient", None, " N/A"])
    item = st.sampled_from(["A", "B", None])

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(item, answer), min_size=1, max_size=60), st.integers(1, 7),
           st.integers(1, 5), st.integers(1, 4))
    def check(rows, parts, salts, out_parts):
        df = spark.createDataFrame(rows, "`CRF Item` string, `Site Response` string").repartition(parts)
        keyed = with_row_key(df, salts=salts)
        got = keyed.collect()
        keys = [r.row_key for r in got]
        assert len(set(keys)) == len(rows)
        seen, expected = {}, []
        for a, b in rows:
            h = hashlib.sha256("\x1f".join(("N" if v is None else "V" + v) for v in (a, b)).encode()).hexdigest()
            seen[h] = seen.get(h, 0) + 1
            expected.append(f"{h}-{seen[h]}")
        assert sorted(keys) == sorted(expected)

        classified = classify(spark.createDataFrame(got, keyed.schema))
        pos = {r.row_key: (r.row_pos, r.Is_Valid) for r in export_positions(classified, n_partitions=out_parts)
               .collect()}
        order = sorted(pos, key=lambda k: (not pos[k][1], k))
        assert [pos[k][0] for k in order] == list(range(len(rows)))

    check()


def test_unique_ids_move_no_row(spark, tmp_dir):
    """With unique ids the key is a projection: one scan, no exchange."""
    spark.range(50).selectExpr("cast(id as string) id", "'x' v").write.parquet(tmp_dir + "/t")
    plan = with_row_key(spark.read.parquet(tmp_dir + "/t"), id_col="id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_repeated_ids_cost_one_scan_of_the_rest(spark, tmp_dir):
    rows = spark.range(60).selectExpr("cast(if(id < 5, 1, id) as string) id", "cast(id as string) v")
    rows.write.parquet(tmp_dir + "/t")
    keyed = with_row_key(spark.read.parquet(tmp_dir + "/t"), id_col="id")
    assert keyed._jdf.queryExecution().executedPlan().toString().count(tmp_dir) == 1
    assert keyed.select("row_key").distinct().count() == 60

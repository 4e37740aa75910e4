"""Review queue, corrections (last wins, idempotent), agreement, worklist."""

from pyspark.sql import types as T

from replysift.operators import review as rv

SCHEMA = T.StructType([
    T.StructField("row_key", T.StringType()), T.StructField("Query ID", T.StringType()),
    T.StructField("Site Response", T.StringType()),
    T.StructField("LLM_Classification", T.StringType()), T.StructField("Confidence", T.DoubleType()),
    T.StructField("Reasoning", T.StringType()), T.StructField("Human_Reviewed", T.BooleanType()),
])
ROWS = [
    ("a", "1", "amended", "Affirmative", 0.82, "one cue", False),
    ("b", "2", "how many?", "Confused", 0.57, "asks", False),
    ("c", "3", "Friday", "Miscellaneous", 0.33, "no cue", False),
    ("d", "4", None, "INVALID", None, "Empty or invalid response", False),
    ("e", "5", "x", "Weird", 0.65, "odd", False),
    ("f", "6", "y", "Miscellaneous", None, "no number", False),
]


def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def corrections(spark, rows):
    return spark.createDataFrame(rows, "row_key string, corrected_label string, seq long")


def test_queue_modes(spark):
    low = {r.row_key for r in rv.review_queue(df(spark), 0.7, "low").collect()}
    assert low == {"b", "c", "e"}
    all_ = {r.row_key for r in rv.review_queue(df(spark), 0.7, "all").collect()}
    assert all_ == {"a", "b", "c", "e", "f"}
    page = [r.row_key for r in rv.review_page(rv.review_queue(df(spark), 0.7, "all"), 2).collect()]
    assert page == ["c", "b"]


def test_apply_changes_exactly_matched_rows(spark):
    c = corrections(spark, [("c", "Affirmative", 1), ("c", "Confused", 2), ("d", "Confused", 1),
                            ("zz", "Confused", 1), ("b", "NotACategory", 1)])
    out = {r.row_key: r for r in rv.apply_corrections(df(spark), c).collect()}
    assert out["c"].LLM_Classification == "Confused"                 # last seq wins
    assert (out["c"].Human_Reviewed, out["c"].Confidence, out["c"].Reasoning) == (
        True, 1.0, "Corrected via human review")
    assert out["c"].Original_Classification == "Miscellaneous"
    assert out["d"].LLM_Classification == "INVALID" and out["d"].Human_Reviewed is False
    assert out["b"].LLM_Classification == "Confused" and out["b"].Human_Reviewed is False
    for k in "abef":
        assert tuple(out[k])[:7] == tuple(r for r in ROWS if r[0] == k)[0]
    assert len(out) == len(ROWS)


def test_apply_twice_equals_once(spark):
    c = corrections(spark, [("c", "Affirmative", 1), ("a", "Confused", 1)])
    once = rv.apply_corrections(df(spark), c)
    twice = rv.apply_corrections(once, c)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_pending_defaults(spark):
    page = rv.review_page(rv.review_queue(df(spark), 0.7, "all"), 50, "key")
    p = {r.row_key: r.corrected_label for r in rv.pending_corrections(page).collect()}
    assert p == {"e": "Miscellaneous"}                                # unknown label pending at once
    c = corrections(spark, [("a", "Confused", 1), ("b", "Confused", 1)])
    p = {r.row_key: r.corrected_label for r in rv.pending_corrections(page, c).collect()}
    assert p == {"a": "Confused", "e": "Miscellaneous"}


def test_agreement(spark):
    c = corrections(spark, [("a", "Affirmative", 1), ("b", "Affirmative", 1), ("c", "Miscellaneous", 1)])
    agr = {r.model_label: r for r in rv.label_agreement(rv.apply_corrections(df(spark), c)).collect()}
    assert agr["Confused"].Affirmative == 1 and agr["Confused"].agreement == 0.0
    assert agr["Affirmative"].agreement == 1.0 and agr["Miscellaneous"].n_reviewed == 1


def test_worklist_with_audit(spark):
    audit = spark.createDataFrame([("1", 1), ("1", 2), ("9", 3)], "`Query ID` string, n int")
    w = rv.affirmative_worklist(df(spark), audit).collect()
    assert len(w) == 1 and w[0].has_audit_change is True and w[0].n_audit_changes == 2


def test_key_sample_is_partition_independent_and_per_stratum(spark):
    from conftest import listing
    from replysift.operators.filters import key_sample
    from replysift.sources.listing import with_row_key

    n = 4000
    df = with_row_key(listing(spark, ["done"] * n, extra={"Study Alias": ["A" if i % 2 else "B" for i in range(n)]}),
                      id_col="Query ID")
    one = {r.row_key for r in key_sample(df.repartition(1), 0.0, "Study Alias", {"A": 0.1, "B": 0.5}, 3).collect()}
    many = {r.row_key for r in key_sample(df.repartition(7), 0.0, "Study Alias", {"A": 0.1, "B": 0.5}, 3).collect()}
    assert one == many
    a = sum(1 for k in one if int(k) % 2)
    b = len(one) - a
    assert 120 < a < 280 and 850 < b < 1150          # about 10 % of 2000 and 50 % of 2000
    assert key_sample(df, 1.0).count() == n and key_sample(df, 0.0).count() == 0


def test_null_and_tied_seq(spark):
    c = corrections(spark, [("a", "Confused", None), ("b", "Affirmative", 3), ("b", "Miscellaneous", 3), ("c", "Confused", -5),
                            ("c", "Affirmative", None)])
    out = {r.row_key: r for r in rv.apply_corrections(df(spark), c).collect()}
    assert out["a"].LLM_Classification == "Confused" and out["a"].Human_Reviewed   # a lone null seq counts
    assert out["b"].LLM_Classification == "Miscellaneous"                          # a tie: the later category
    assert out["c"].LLM_Classification == "Confused"                               # null comes before any number
    assert all(r.LLM_Classification for r in out.values())


def test_frame_without_reasoning(spark):
    bare = df(spark).drop("Reasoning")
    out = {r.row_key: r for r in rv.apply_corrections(bare, corrections(spark, [("a", "Confused", 1)])).collect()}
    assert out["a"].Reasoning == "Corrected via human review" and out["b"].Reasoning is None


def test_ignored_corrections(spark):
    c = corrections(spark, [("a", "confused", 1), ("zz", "Confused", 2), ("d", "Confused", 3), (None, "Confused", 4), ("b", "Confused", 5)])
    got = {r.seq: r.reason for r in rv.ignored_corrections(df(spark), c).collect()}
    assert got == {1: "unknown label", 2: "unknown row", 3: "invalid answer", 4: "no row key"}

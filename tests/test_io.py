"""CSV read (quotes, line breaks, ragged rows, tokens), column check, sinks."""

import os

import pytest

from conftest import listing
from replysift.config import ListingColumns
from replysift.operators.classify import classify
from replysift.sources.listing import check_columns, listing_profile, preview_rows, read_listing_csv, with_row_key
from replysift.sources.sinks import (
    export_by_category, read_category_export, read_classified_csv, stage, write_csv,
)

CSV = (
    'Query ID,Study Alias,CRF Item,Site Response\n'
    '1,ST-1,AE Term,"corrected, thanks"\n'
    '2,ST-1,Visit Date,"Where is the ""date"" field?\nWe looked twice"\n'
    '3,ST-2,BP,N/A\n'
    '4,ST-2,BP, N/A\n'
    '\n'
    '5,ST-2,BP\n'
    '6,,,NULL\n'
)


def write(tmp_dir, name, text):
    p = os.path.join(tmp_dir, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_read_quotes_newlines_tokens_short_rows(spark, tmp_dir):
    df = read_listing_csv(spark, write(tmp_dir, "l.csv", CSV))
    assert df.columns == ["Query ID", "Study Alias", "CRF Item", "Site Response"]
    rows = {r["Query ID"]: r for r in df.collect()}
    assert len(rows) == 6
    assert rows["1"]["Site Response"] == "corrected, thanks"
    assert rows["2"]["Site Response"] == 'Where is the "date" field?\nWe looked twice'
    assert rows["3"]["Site Response"] is None            # reader token
    assert rows["4"]["Site Response"] == " N/A"           # padded: kept
    assert rows["5"]["Site Response"] is None             # short row padded
    assert rows["6"]["Study Alias"] is None and rows["6"]["Site Response"] is None
    assert all(f.dataType.typeName() == "string" for f in df.schema.fields)
    keep = read_listing_csv(spark, write(tmp_dir, "k.csv", CSV), na_tokens=())
    assert {r["Query ID"]: r for r in keep.collect()}["3"]["Site Response"] == "N/A"


def test_long_row_raises(spark, tmp_dir):
    p = write(tmp_dir, "long.csv", "a,b,c\n1,2,3\n4,5,6,7\n")
    with pytest.raises(ValueError):
        read_listing_csv(spark, p)
    kept = {r.a: r for r in read_listing_csv(spark, p, on_long_rows="keep").collect()}
    assert kept["4"]._surplus_record == "4,5,6,7" and kept["1"]._surplus_record is None


@pytest.mark.parametrize("row", ["2,y,,extra", "2,y,z,", '2,"y, y",z,w', '2,"a ""b"", c",,d', '"x\ny",1,,,'])
def test_surplus_fields_are_never_lost(spark, tmp_dir, row):
    p = write(tmp_dir, "long.csv", f"a,b,c\n1,2,3\n{row}\n")
    with pytest.raises(ValueError):
        read_listing_csv(spark, p)
    with pytest.raises(Exception, match="more fields"):
        read_listing_csv(spark, p, on_long_rows="raise_on_read").select("b").collect()
    rows = read_listing_csv(spark, p, on_long_rows="keep").collect()
    assert sorted(r._surplus_record is not None for r in rows) == [False, True]


@pytest.mark.parametrize("row", ['2,"y, y, y, y"', '2,"a ""b"", c",d', '"x, \ny",,', "2"])
def test_quoted_separators_and_short_rows_are_no_surplus(spark, tmp_dir, row):
    p = write(tmp_dir, "ok.csv", f"a,b,c\n1,2,3\n{row}\n")
    assert read_listing_csv(spark, p).count() == 2
    assert len(read_listing_csv(spark, p, on_long_rows="raise_on_read").collect()) == 2
    assert all(r._surplus_record is None for r in read_listing_csv(spark, p, on_long_rows="keep").collect())


def test_long_rows_in_an_exported_table_fail(spark, tmp_dir):
    p = write(tmp_dir, "x.csv", "Query ID,Confidence\n1,0.5\n2,,3\n")
    with pytest.raises(Exception, match="more fields"):
        read_classified_csv(spark, p).collect()


def test_headers_with_dots_and_quotes(spark, tmp_dir):
    from replysift.operators import analytics as an
    from replysift.operators import filters as fl

    p = write(tmp_dir, "dots.csv", "Query.ID,CRF.Item,Study.`x`,Site Response.v1\n1,A,S,Which one?\n2,NA,S,saved\n")
    cols = ListingColumns(response="Site Response.v1", item="CRF.Item", query_id="Query.ID", study="Study.`x`")
    df = classify(with_row_key(read_listing_csv(spark, p), id_col="Query.ID"), cols)
    assert {r.row_key: r.LLM_Classification for r in df.collect()} == {"1": "Confused", "2": "Affirmative"}
    assert [tuple(r) for r in an.top_items(df, cols, "Confused", 5).collect()] == [("A", 1)]
    assert an.study_category_pivot(df, cols).first().Confused == 1
    assert fl.filter_options(df, cols).count() == 1
    assert with_row_key(read_listing_csv(spark, p)).select("row_key").distinct().count() == 2


def test_column_check(spark):
    df = spark.createDataFrame([("1", "done")], "`Query ID` string, Response string")
    rep = check_columns(df, strict=False)
    assert rep.missing == ("Site Response", "CRF Item") and not rep.response_present
    with pytest.raises(ValueError):
        check_columns(df)
    ok = check_columns(df, ListingColumns(response="Response"), strict=False)
    assert ok.missing == ("CRF Item",) and ok.response_present


def test_profile_and_preview(spark):
    df = with_row_key(listing(spark, [f"r{i}" for i in range(25)]), id_col="Query ID")
    p = listing_profile(df).first()
    assert (p.n_rows, p.n_columns) == (25, 3)  # the row key is no column of the listing
    assert [r.row_key for r in preview_rows(df).collect()] == sorted(str(i) for i in range(25))[:10]


def test_csv_round_trip_and_category_export(spark, tmp_dir):
    resp = ['say "hi", ok?', "done", None, " N/A", "line\nbreak", "patient stable", "   "]
    df = classify(with_row_key(listing(spark, resp), id_col="Query ID"))
    out = os.path.join(tmp_dir, "full")
    write_csv(df, out)
    back = read_classified_csv(spark, out)
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=str) == sorted(
        map(tuple, df.collect()), key=str)
    cat = os.path.join(tmp_dir, "bycat")
    export_by_category(df, cat)
    slugs = sorted(d for d in os.listdir(cat) if d.startswith("category_slug="))
    assert slugs == ["category_slug=affirmative", "category_slug=confused",
                     "category_slug=medically_related", "category_slug=miscellaneous"]
    assert read_category_export(spark, cat, "confused").count() == 1
    assert read_category_export(spark, cat).count() == df.where("Is_Valid").count()


def test_stage_reads_back(spark):
    df = listing(spark, ["a", "b"])
    st = stage(df, "unit")
    assert sorted(map(tuple, st.collect())) == sorted(map(tuple, df.collect()))
    assert "FileScan parquet" in st._jdf.queryExecution().executedPlan().toString()


class _StubConf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)

    def set(self, key, value):
        self.values[key] = value


class _StubContext:
    def getCheckpointDir(self):
        return None


class _StubSession:
    def __init__(self, values):
        self.conf = _StubConf(values)
        self.sparkContext = _StubContext()


def test_stage_root_needs_shared_folder_on_a_cluster():
    from replysift.sources.sinks import stage_root

    assert stage_root(_StubSession({"spark.checkpoint.dir": "hdfs://nn/ckpt/"})) == "hdfs://nn/ckpt"
    with pytest.raises(RuntimeError):
        stage_root(_StubSession({"spark.master": "yarn"}))


def test_export_positions_dense_ordered_and_partition_independent(spark):
    from replysift.operators.filters import export_positions

    responses = ["done", "", "How?", "12.5", "patient", "ok", None, "fixed", "nan", "unclear"] * 7
    df = with_row_key(classify(listing(spark, responses, ids=[f"q{i:03d}" for i in range(len(responses))])),
                      id_col="Query ID")
    expected = sorted(((not r["Is_Valid"], r["row_key"]) for r in df.collect()))
    expected = {key: pos for pos, (_, key) in enumerate(expected)}
    for parts in (1, 3):
        got = {r["row_key"]: r["row_pos"] for r in export_positions(df, n_partitions=parts).collect()}
        assert got == expected


def test_long_row_raises_on_read_without_extra_pass(spark, tmp_dir):
    p = write(tmp_dir, "long2.csv", "a,b,c\n1,2,3\n4,5,6,7\n")
    lazy = read_listing_csv(spark, p, on_long_rows="raise_on_read")   # no job yet
    with pytest.raises(Exception, match="more fields than the header"):
        lazy.select("a").collect()                                     # pruned read still checks
    ok = read_listing_csv(spark, write(tmp_dir, "ok.csv", CSV), on_long_rows="raise_on_read")
    eager = read_listing_csv(spark, write(tmp_dir, "ok2.csv", CSV))
    assert sorted(map(tuple, ok.collect())) == sorted(map(tuple, eager.collect()))
    with pytest.raises(ValueError):
        read_listing_csv(spark, p, on_long_rows="never")


def test_raise_on_read_fails_the_classify_job(spark, tmp_dir):
    bad = CSV + '7,ST-3,BP,done,extra field\n'
    listing_df = read_listing_csv(spark, write(tmp_dir, "bad.csv", bad), on_long_rows="raise_on_read")
    with pytest.raises(Exception, match="more fields than the header"):
        classify(listing_df).select("LLM_Classification").collect()


class _StaticConf(_StubConf):
    def set(self, key, value):  # Spark 4: spark.checkpoint.dir cannot change at run time
        raise RuntimeError("CANNOT_MODIFY_CONFIG")


class _RecordingContext:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = "file:" + d + "/ctx"


def test_stage_root_local_fallback_sets_only_the_context_folder():
    from replysift.sources.sinks import stage_root

    s = _StubSession({"spark.master": "local[2]"})
    s.conf = _StaticConf({"spark.master": "local[2]"})
    s.sparkContext = _RecordingContext()
    first = stage_root(s)
    assert first == s.sparkContext.dir and first.startswith("file:")
    assert stage_root(s) == first          # later calls keep the same root

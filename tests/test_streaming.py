"""A CSV file stream classified with available-now equals the batch result."""

import os

import pytest

from replysift.operators.classify import classify
from replysift.sources.listing import read_listing_csv
from replysift.streaming import stream as st

HEADER = ["Query ID", "CRF Item", "Site Response"]


def test_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for part in range(3):
        with open(os.path.join(src, f"p{part}.csv"), "w") as f:
            f.write(",".join(f'"{h}"' for h in HEADER) + "\n")
            for i in range(20):
                resp = ["done", "why?", "patient ok", "", "N/A", "12", '"a ""quoted"" one"'][i % 7]
                f.write(f"{part}-{i},item{i % 3},{resp}\n")
    stream = st.read_csv_listing_stream(spark, src, HEADER)
    got = st.run_to_table(spark, st.classify_stream(stream))
    batch = classify(read_listing_csv(spark, src))
    cols = batch.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.collect()))
    counts = st.run_counts_to_table(spark, st.classify_stream(st.read_csv_listing_stream(spark, src, HEADER)))
    assert sum(r.n for r in counts.collect()) == batch.where("Is_Valid").count()


def swap_case(tmp_dir, text):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "p.csv"), "w") as f:
        f.write(text)
    return src


@pytest.mark.parametrize("text", ["Site Response,Query ID\ndone,1\n", "Query ID,Site Response\n1,done,extra\n", "Query ID,Site Response\n1,,extra\n"])
def test_stream_fails_rather_than_misplace_or_lose_values(spark, tmp_dir, text):
    stream = st.read_csv_listing_stream(spark, swap_case(tmp_dir, text), ["Query ID", "Site Response"])
    with pytest.raises(Exception, match="header|more fields"):
        st.run_to_table(spark, st.classify_stream(stream))

"""The pipeline against brute force: every stage worked out anew on its own input."""

import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from odd import SCHEMA, odd_documents
from replysift.llm import gbt_quality, mixing
from replysift.llm import sentencepiece_backend as sb
from test_line_dedup import brute as brute_lines
from test_partenum import brute as brute_join

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows) of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("pipeline")
    for name, step in cp.STAGES:
        before = docs.collect()
        step(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append((before, docs.collect(), docs.columns))
    return out


def test_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    assert all(c == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, c in stages[:4])
    assert all(r.n_chars == len(r.text) for r in stages[3][1])


def test_quality(spark, stages):
    before, after, _ = stages[0]
    trees = gbt_quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), gbt_quality.usable_fold())
    score = trees.predict(np.array([gbt_quality.statistics(r.text.encode()) for r in before]))
    assert {r.doc_id for r in after} == {r.doc_id for r, s in zip(before, score, strict=True) if s >= 0.3}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.doc_id for r in before if labels.get(r.doc_id) == 1]
    assert len({r.doc_id for r in after}.intersection(good)) > 0.95 * len(good)


def test_lines(stages):
    before, after, _ = stages[1]
    want = {r.doc_id: x[0] for r, x in zip(before, brute_lines([r.text for r in before], 10), strict=True)}
    assert {r.doc_id: r.text for r in after} == want


def test_near_duplicates(stages):
    before, after, _ = stages[2]
    want = {i for i, _, c in brute_join([(r.doc_id, r.text) for r in before], 5, 80, 100) if i == c}
    assert {r.doc_id for r in after} == want and len(after) == len(want) < len(before)


def test_mix(stages):
    before, after, _ = stages[3]
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += len(r.text.encode().split())
    for r in after:
        taken[r.source] += len(r.text.encode().split())
    order = sorted(size)
    for s, w in zip(order, mixing.targets([size[s] for s in order], mixing.cycling_weights(order)), strict=True):
        assert abs(taken[s] - w) <= 0.02 * w + mixing.BLOCK_WORDS, (s, taken[s], w)
    text = {r.doc_id: r.text for r in before}
    assert all(r.text in text[r.doc_id] for r in after)


def test_ids(stages):
    before, after, columns = stages[4]
    assert columns == ["doc_id", "source", "n_tokens", "ids"]
    ids = sb.Backend(public_tokenizers.path("piece_bpe_32k.model")).encode(pa.array([r.text for r in before], pa.large_string()))
    assert Counter((r.doc_id, bytes(r.ids)) for r in after) == Counter((r.doc_id, x) for r, x in zip(before, ids, strict=True))


def test_run_gives_the_last_stage(spark, stages):
    assert Counter((r.doc_id, bytes(r.ids)) for r in cp.run(spark, SF).collect()) == Counter((r.doc_id, bytes(r.ids)) for r in stages[4][1])


def test_stages_take_odd_and_no_documents(spark, tmp_dir):
    for docs in (odd_documents(spark, ("score", "node", "taken", "ids")), spark.createDataFrame([], SCHEMA)):
        n = docs.count()
        for i, (_, step) in enumerate(cp.STAGES):
            out = step(spark, docs, SF)
            if i < 4:
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert (out.count() > 0) == (n > 0) or i == 0


def test_guard_is_in_the_entry_alone():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is cp.run and "pipeline" not in e.oracle_sql()
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()}
    assert sys.modules["corpus_pipeline"] is cp

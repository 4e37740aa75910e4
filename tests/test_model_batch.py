"""M1-M9: batching bounds, prompt text, reply parsing and per-position fallback."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import listing
from replysift.operators.classify import validate
from replysift.operators.model_batch import (
    batch_rows, build_prompts, classify_with_model, match_results,
)
from fake_model import keyword_model_factory, prompt_answers
from replysift.sources.listing import with_row_key

# the stand-in models are defined in the tests; ship them to workers by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules["fake_model"])

FALLBACK = ("Miscellaneous", 0.0, "Classification failed — manual review needed")


def keyed(spark, responses):
    return with_row_key(listing(spark, responses), id_col="Query ID")


def test_batches_are_bounded_and_cover_all_valid_rows(spark):
    resp = [f"answer {i}" for i in range(137)] + [None, "", "12"]
    v = validate(keyed(spark, resp))
    b = batch_rows(v, batch_size=5, n_buckets=4)
    sizes = [r[0] for r in b.groupBy("bucket", "batch").count().select("count").collect()]
    assert max(sizes) <= 5 and sum(sizes) == 137
    p = build_prompts(b).collect()
    assert sum(r.n_rows for r in p) == 137
    one = p[0]
    assert f"\nLINES: {one.n_rows}\n" in one.prompt
    assert len(prompt_answers(one.prompt)) == one.n_rows
    with pytest.raises(ValueError):
        batch_rows(v, batch_size=40)


def replies_df(spark, cases):
    rows = [(keys, reply) for keys, reply in cases]
    return spark.createDataFrame(rows, "row_keys array<string>, reply string")


def obj(label, conf, reason="r"):
    return {"index": 99, "classification": label, "confidence": conf, "reasoning": reason}


def test_reply_parsing_and_fallback(spark):
    good = json.dumps([obj("Confused", 0.8), obj("Affirmative", 0.9)])
    cases = [
        (["a1", "a2"], good),                                              # plain
        (["b1"], "```json\n" + json.dumps([obj("Affirmative", 0.7)]) + "\n```"),  # fenced
        (["c1", "c2"], None),                                              # failed call
        (["d1", "d2"], "I could not do it."),                              # prose only
        (["e1", "e2", "e3"], good),                                        # short reply
        (["f1"], good),                                                    # long reply: surplus dropped
        (["g1"], "[]"),                                                    # empty array
        (["h1"], json.dumps([{"index": 0, "classification": "Confused"}])),  # missing fields
        (["i1"], '[{"classification": "Affirmative", "confidence": "0.7", "reasoning": "q"}]'),
        (["j1"], '[{"classification": "Affirmative", "confidence": "high", "reasoning": "q"}]'),
        (["k1"], '[{"classification": null, "confidence": 0.5, "reasoning": "q"}]'),
        (["l1"], '[{"classification": "Other", "confidence": 0.5, "reasoning": "q"},]'),  # trailing comma
        (["m1"], '[{"classification": "Other", "confidence": 0.5, "reasoning": "q"}]'),   # unknown label kept
        (["n1"], "[1, 2]"),                                                # not objects
        (["o1"], "Here:\n" + json.dumps([obj("Confused", 0.6)]) + "\nthanks"),  # prose around
    ]
    got = {r.row_key: (r._m_label, r._m_conf, r._m_reason)
           for r in match_results(replies_df(spark, cases)).collect()}
    assert got["a1"] == ("Confused", 0.8, "r") and got["a2"] == ("Affirmative", 0.9, "r")
    assert got["b1"] == ("Affirmative", 0.7, "r")
    assert got["c1"] == got["c2"] == got["d1"] == FALLBACK
    assert got["e1"][0] == "Confused" and got["e3"] == FALLBACK
    assert got["f1"] == ("Confused", 0.8, "r")
    assert got["g1"] == FALLBACK
    assert got["h1"] == ("Confused", None, None)
    assert got["i1"] == ("Affirmative", 0.7, "q")
    assert got["j1"] == ("Affirmative", None, "q")
    assert got["k1"] == FALLBACK
    assert got["l1"] == FALLBACK
    assert got["m1"] == ("Other", 0.5, "q")
    assert got["n1"] == FALLBACK
    assert got["o1"] == ("Confused", 0.6, "r")
    assert len(got) == sum(len(k) for k, _ in cases)


def flaky_factory():
    def factory():
        def call(prompt):
            answers = prompt_answers(prompt)
            if any("boom" in a for a in answers):
                raise RuntimeError("service down")
            return json.dumps([obj("Affirmative", 0.9, "ok") for _ in answers])
        return call
    return factory


def test_classify_with_model_keeps_every_row(spark):
    resp = [f"fine {i}" for i in range(40)] + ["boom"] + [None, "nan"]
    df = keyed(spark, resp)
    out = classify_with_model(df, flaky_factory(), batch_size=5, n_buckets=3)
    rows = out.collect()
    assert len(rows) == len(resp)
    by = {r["Site Response"]: r for r in rows}
    assert by["nan"].LLM_Classification == "INVALID" and by["nan"].Confidence is None
    assert by["boom"].LLM_Classification == "Miscellaneous" and by["boom"].Confidence == 0.0
    ok = [r for r in rows if r.LLM_Classification == "Affirmative"]
    assert len(ok) >= 30 and all(r.Reasoning == "ok" for r in ok)
    assert F is not None


def partition_reporting_factory():
    def call(prompt):
        from pyspark import TaskContext

        pid = str(TaskContext.get().partitionId())
        return json.dumps([obj("Affirmative", 0.9, pid) for _ in prompt_answers(prompt)])
    return call


def test_model_calls_keep_bucket_parallelism(spark):
    # a small listing: adaptive execution would coalesce its shuffle into one
    # partition, serialising every model call; the buckets must stay separate
    out = classify_with_model(keyed(spark, [f"answer {i}" for i in range(200)]), partition_reporting_factory,
                              batch_size=5, n_buckets=4, persist_replies=False)
    pids = {r.Reasoning for r in out.select("Reasoning").collect()}
    assert len(pids) > 1
    # default bucket count: several buckets per partition, so every partition calls
    out = classify_with_model(keyed(spark, [f"answer {i}" for i in range(400)]), partition_reporting_factory,
                              batch_size=5, persist_replies=False)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({r.Reasoning for r in out.select("Reasoning").collect()}) == n_parts


def test_answers_with_quotes_and_line_breaks_survive_the_prompt(spark):
    answers = ['say "yes" | answer="no"', "two\nlines", "LINES: 3", "{}"]
    p = build_prompts(batch_rows(validate(keyed(spark, answers)), batch_size=5, n_buckets=1)).collect()
    assert sorted(prompt_answers(p[0].prompt)) == sorted(answers)


def test_result_without_reasoning_is_not_stamped_as_failed(spark):
    def factory():
        return lambda prompt: json.dumps([{"classification": "Confused", "confidence": 0.9} for _ in prompt_answers(prompt)])

    row = classify_with_model(keyed(spark, ["where?"]), factory).first()
    assert (row.LLM_Classification, row.Confidence, row.Reasoning) == ("Confused", 0.9, None)


def test_repeated_and_missing_ids_keep_their_rows(spark):
    df = with_row_key(listing(spark, ["one", "two", "two", "three", "four"], ids=["1", "1", "1", None, "2"]), id_col="Query ID")
    out = classify_with_model(df, flaky_factory()).collect()
    assert len(out) == 5 and all(r.LLM_Classification == "Affirmative" for r in out)
    assert len({r.row_key for r in out}) == 5 and "2" in {r.row_key for r in out}


def test_own_categories_reach_the_model(spark):
    from replysift.operators.model_batch import default_instructions

    text = default_instructions(categories=("Open", "Closed"), descriptions={"Open": "work is left"})
    assert "1. Open = work is left" in text and "2. Closed" in text and "Affirmative" not in text


def test_stand_in_model_equals_the_native_scorer(spark):
    from replysift.operators.classify import classify

    answers = ["Stop date amended", "not corrected yet", "which one?", "pain", "hello", "saved, but fever"]
    df = keyed(spark, answers)
    cols = ["row_key", "LLM_Classification", "Confidence", "Reasoning"]
    a = {tuple(r) for r in classify(df).select(*cols).collect()}
    b = {tuple(r) for r in classify_with_model(df, keyword_model_factory()).select(*cols).collect()}
    assert a == b


def test_package_zip_goes_to_the_executors(spark):
    from replysift import session

    files = []
    real = spark.sparkContext.addPyFile
    try:
        spark.sparkContext.addPyFile = lambda p: files.append(p)
        if hasattr(spark.sparkContext, session._SHIPPED_ATTR):
            delattr(spark.sparkContext, session._SHIPPED_ATTR)
        session.ship_package(spark)
    finally:
        spark.sparkContext.addPyFile = real
    import zipfile

    assert len(files) == 1 and "://" not in files[0]
    assert "replysift/operators/model_batch.py" in zipfile.ZipFile(files[0]).namelist()


def counting_factory(log):
    """A stand-in that writes a file for each prompt asked; prompts with ``fail`` in them raise."""
    def factory():
        import hashlib
        import os
        import uuid

        def call(prompt):
            with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
                f.write(hashlib.sha256(prompt.encode()).hexdigest())
            if "fail" in prompt and not os.path.exists(os.path.join(log, "healed")):
                raise RuntimeError("no answer")
            return keyword_model_factory()()(prompt)

        return call

    return factory


def test_ledger_asks_only_what_is_open(spark, tmp_dir):
    import os

    log, ledger = tmp_dir + "/log", tmp_dir + "/ledger"
    os.makedirs(log)
    answers = [f"corrected value {i}" for i in range(60)] + ["will fail", "", None]
    first = keyed(spark, answers)
    plain = classify_with_model(first, keyword_model_factory(), batch_size=5, n_buckets=4)

    def run(df):
        out = classify_with_model(df, counting_factory(log), batch_size=5, n_buckets=4, ledger=ledger)
        asked = [n for n in os.listdir(log) if n != "healed"]
        rows = {r.row_key: (r.LLM_Classification, r.Confidence) for r in out.collect()}
        for n in asked:
            os.rename(os.path.join(log, n), os.path.join(tmp_dir, n))
        return rows, len(asked)

    rows, asked = run(first)
    assert asked >= 13
    failed = {k for k, v in rows.items() if v == FALLBACK[:2]}
    assert failed and failed != set(rows)
    again, asked_again = run(first)
    assert again == rows and asked_again == 1  # only the call that failed
    open(os.path.join(log, "healed"), "w").close()
    assert run(first)[1] == 1
    healed, asked_last = run(first)
    assert asked_last == 0
    assert healed == {r.row_key: (r.LLM_Classification, r.Confidence) for r in plain.collect()}

"""Category definitions and prompt content (M3, M11, M12): the four categories,
their descriptions, the default rule set, and what a batch prompt tells a model."""

from conftest import listing
from replysift.config import CATEGORIES, CATEGORY_DESCRIPTIONS, DEFAULT_RULES
from replysift.operators.classify import validate
from replysift.operators.model_batch import batch_rows, build_prompts, default_instructions
from replysift.sources.listing import with_row_key


def test_four_categories_with_descriptions():
    assert CATEGORIES == ("Affirmative", "Confused", "Medically Related", "Miscellaneous")
    assert set(CATEGORY_DESCRIPTIONS) == set(CATEGORIES)
    assert all(CATEGORY_DESCRIPTIONS[c].strip() for c in CATEGORIES)


def test_default_rule_set_labels_are_the_categories():
    labels = [r.label for r in DEFAULT_RULES.rules] + [DEFAULT_RULES.default_label]
    assert sorted(labels) == sorted(CATEGORIES)
    assert DEFAULT_RULES.default_label == "Miscellaneous"


def test_instructions_name_every_category_and_the_reply_format():
    text = default_instructions()
    for c in CATEGORIES:
        assert f". {c} = " in text
    for field in ("index", "classification", "confidence", "reasoning"):
        assert field in text
    assert "one JSON list" in text


def test_prompt_carries_item_and_whole_answer(spark):
    long_answer = "word " * 3000 + "end"
    df = with_row_key(
        listing(spark, ["Corrected as requested", long_answer, None], items=["AE Term", "Dose", "BP"]),
        id_col="Query ID",
    )
    p = build_prompts(batch_rows(validate(df), batch_size=5, n_buckets=1)).collect()
    assert len(p) == 1 and p[0].n_rows == 2          # the null answer is invalid: never sent
    prompt = p[0].prompt
    assert '{"item":"AE Term","answer":"Corrected as requested"}' in prompt
    assert long_answer.strip() in prompt             # whole text, no prefix
    assert "LINES: 2" in prompt

"""Registered queries: every operator of the inventory run over whole tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` and reads the benchmark tables
(or listings Spark derives from them). The SQL twins are in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    CATEGORIES, CONFIDENCE, DEFAULT_COLUMNS, DEFAULT_RULES, HUMAN_REVIEWED, IS_VALID, LABEL, REASONING, ROW_KEY, CueRule, ListingColumns, RuleSet,
)
from ..functions.noise import learn_transitions
from ..functions.phrases import rule_tables
from ..operators import analytics as an
from ..operators import filters as fl
from ..operators import review as rv
from ..operators.classify import classify, classify_by_table, validate, validity_counts
from ..operators.model_batch import apply_results, batch_rows, build_prompts, match_results, open_prompts, with_digest
from ..operators.summary import summary_text
from ..sources import derived as dv
from ..sources.label_table import LabelTable
from ..sources.listing import (
    SURPLUS_COLUMN, column_fill, listing_profile, normalise_null_tokens, preview_rows, read_listing_csv, spread, with_row_key,
)
from ..sources.places import PLACE, with_place
from ..sources.sinks import (
    export_by_category, new_stage_path, read_category_export, read_classified_csv, stage, stage_scope, write_csv,
)
from ..streaming import stream as st

C = DEFAULT_COLUMNS
OUT = [IS_VALID, LABEL, CONFIDENCE, REASONING, HUMAN_REVIEWED]

# Fixed parameters of the registered queries.
MODEL_BUCKET_ROWS = 300  # event ids of a bucket: more events, more buckets
MODEL_BATCH = 15
FILTER_ITEM = "click-3"
SITE_MIN_ROWS = 5


# --------------------------------------------------------------------- listings

def events_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Events listing, reader null tokens applied, keyed by its unique query id."""
    return with_row_key(normalise_null_tokens(dv.events_listing(spark, sf)), id_col=C.query_id)


def events_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Classified events listing as a stage table.

    The text scan runs once, in the write; every analytic then reads Parquet
    with pushed filters and pruned columns, and label filters prune whole
    folders (the table is partitioned by label). Without the stage, a filter on the
    label or confidence would be pushed below the scoring projection and
    re-evaluate the text scan inside the filter.
    """
    return stage(classify(events_keyed(spark, sf)), "events-classified", partition_by=[LABEL])


def documents_classified(spark: SparkSession, sf: str) -> DataFrame:
    return stage(classify(documents_keyed(spark, sf)), "documents-classified", partition_by=[LABEL])


def documents_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return with_row_key(normalise_null_tokens(dv.documents_listing(spark, sf)), id_col=C.query_id)


def conversations_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return with_row_key(normalise_null_tokens(dv.conversations_listing(spark, sf)), id_col=C.query_id)


def lineitem_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem listing: query ids repeat, so rows are keyed by content + ordinal."""
    return with_row_key(normalise_null_tokens(dv.lineitem_listing(spark, sf)))


# --------------------------------------------------------------------- queries

def q_validate_rows(spark, sf):
    v = validate(events_keyed(spark, sf))
    return v.select(ROW_KEY, C.response, IS_VALID)


def q_validity_counts(spark, sf):
    return validity_counts(validate(events_keyed(spark, sf)))


def q_classify_rules(spark, sf):
    return events_classified(spark, sf)


def q_classify_documents(spark, sf):
    d = documents_classified(spark, sf)
    return d.select(ROW_KEY, C.study, C.site, C.item, *OUT)


def q_classify_lineitem(spark, sf):
    return classify(lineitem_keyed(spark, sf)).select(ROW_KEY, C.query_id, C.study, C.item, *OUT)


def q_classify_conversations(spark, sf):
    return classify(conversations_keyed(spark, sf)).select(ROW_KEY, "Subject", C.item, *OUT)


def q_row_keys_lineitem(spark, sf):
    return lineitem_keyed(spark, sf)


def q_listing_profile(spark, sf):
    return listing_profile(events_keyed(spark, sf))


def q_listing_preview(spark, sf):
    return preview_rows(events_keyed(spark, sf))


def q_category_counts(spark, sf):
    return an.category_counts(events_classified(spark, sf))


def q_category_counts_documents(spark, sf):
    return an.category_counts(documents_classified(spark, sf))


def q_category_counts_json(spark, sf):
    return an.category_counts_json(events_classified(spark, sf))


def q_validate_documents_strict(spark, sf):
    v = validate(documents_keyed(spark, sf), C, reject_gibberish=True)
    return v.select(ROW_KEY, C.study, IS_VALID)


def q_category_cards(spark, sf):
    return an.category_cards(events_classified(spark, sf))


def q_results_header(spark, sf):
    return an.results_header(events_classified(spark, sf))


def q_top_confused_items(spark, sf):
    return an.top_items(events_classified(spark, sf), C, "Confused", 10)


def q_top_confused_items_15(spark, sf):
    return an.top_items(events_classified(spark, sf), C, "Confused", 15)


def q_top_confused_sources(spark, sf):
    return an.top_items(documents_classified(spark, sf), C, "Confused", 15)


def q_confidence_histogram(spark, sf):
    return an.confidence_histogram(events_classified(spark, sf))


def q_confidence_histogram_documents(spark, sf):
    return an.confidence_histogram(documents_classified(spark, sf))


def q_study_category_pivot(spark, sf):
    return an.study_category_pivot(events_classified(spark, sf))


def lineitem_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Study, label and confidence of the classified lineitem listing, without row keys.
    Its study (return flag) has three values, one of them holding about half of all rows: a
    hot group key for the aggregates below. The narrow stage holds what they read: filters on
    label or confidence would otherwise be pushed below the scoring and copy it."""
    classified = classify(normalise_null_tokens(dv.lineitem_listing(spark, sf)))
    return stage(classified.select(C.study, IS_VALID, LABEL, CONFIDENCE), "lineitem-labels")


def q_study_category_pivot_lineitem(spark, sf):
    return an.study_category_pivot(lineitem_classified(spark, sf))


def q_confidence_histogram_lineitem(spark, sf):
    return an.confidence_histogram(lineitem_classified(spark, sf))


def q_study_category_counts(spark, sf):
    return an.study_category_counts(events_classified(spark, sf))


def q_medical_listing(spark, sf):
    return fl.medical_listing(events_classified(spark, sf))


def q_filtered_rows(spark, sf):
    return fl.filter_results(events_classified(spark, sf), CATEGORIES, "High", FILTER_ITEM)


def q_filtered_rows_low(spark, sf):
    return fl.filter_results(events_classified(spark, sf), ("Confused", "Miscellaneous", "INVALID"), "Low")


def q_filtered_rows_medium(spark, sf):
    return fl.filter_results(events_classified(spark, sf), CATEGORIES, "Medium")


def q_filter_options(spark, sf):
    return fl.filter_options(events_classified(spark, sf))


def q_shown_of_total(spark, sf):
    return fl.shown_of_total(events_classified(spark, sf), CATEGORIES, "High", FILTER_ITEM)


def q_review_queue(spark, sf):
    page = rv.review_page(rv.review_queue(events_classified(spark, sf), 0.70, "low"), 50, "confidence")
    return fl.review_preview(page).select(ROW_KEY, LABEL, CONFIDENCE, "preview", C.item, REASONING)


def q_review_queue_all(spark, sf):
    page = rv.review_page(rv.review_queue(events_classified(spark, sf), 0.70, "all"), 50, "key")
    return page.select(ROW_KEY, LABEL, CONFIDENCE, C.response)


def q_pending_corrections(spark, sf):
    page = rv.review_page(rv.review_queue(events_classified(spark, sf), 0.70, "all"), 50, "key")
    return rv.pending_corrections(page, dv.events_corrections(spark, sf))


def q_apply_corrections(spark, sf):
    return rv.apply_corrections(events_classified(spark, sf), dv.events_corrections(spark, sf))


def q_label_agreement(spark, sf):
    fixed = rv.apply_corrections(events_classified(spark, sf), dv.events_corrections(spark, sf))
    return rv.label_agreement(fixed)


def q_confusion_alert(spark, sf):
    return an.confusion_alerts(events_classified(spark, sf))


def q_site_confusion(spark, sf):
    return an.site_confusion(events_classified(spark, sf), C, SITE_MIN_ROWS)


def q_affirmative_worklist(spark, sf):
    return rv.affirmative_worklist(events_classified(spark, sf), dv.events_audit(spark, sf))


def q_summary_bundle(spark, sf):
    return an.summary_bundle(events_classified(spark, sf))


def q_summary_text(spark, sf):
    return summary_text(events_classified(spark, sf))


def q_prompt_batches(spark, sf):
    v = validate(events_keyed(spark, sf))
    p = build_prompts(batch_rows(v, C, MODEL_BATCH, bucket_by=C.query_id, bucket_rows=MODEL_BUCKET_ROWS))
    return p.select("bucket", "batch", "n_rows", F.array_join("row_keys", ",").alias("row_keys"), "prompt")


def q_parse_replies(spark, sf):
    """M5-M9: replies of every kind, a batch of three rows for each event, parsed and matched.
    Parsing is heavy for its few bytes, so replies are dealt out over the shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return match_results(spread(dv.events_replies(spark, sf), parts))


def q_model_results(spark, sf):
    """J1 + M9: the parsed replies brought to the rows of the events listing; rows whose
    batch has no reply fall back."""
    replies = dv.events_replies(spark, sf).where("event_id % 3 = 0").select(
        F.array(*[(F.col("event_id") + i).cast("string") for i in range(3)]).alias("row_keys"), "reply")
    return apply_results(validate(events_keyed(spark, sf)), match_results(replies))


def q_confused_rows(spark, sf):
    return fl.confused_rows(events_classified(spark, sf))


def q_pending_corrections_all(spark, sf):
    """R2 over the whole queue instead of one page."""
    queue = rv.review_queue(events_classified(spark, sf), 0.70, "all")
    return rv.pending_corrections(queue, dv.events_corrections(spark, sf))


def q_ignored_corrections(spark, sf):
    """Corrections left out, with the reason: ids are moved and labels spoilt for some."""
    c = dv.events_corrections(spark, sf)
    key = F.when(F.col("seq").isNull(), F.lit(None).cast("string")).when(F.col("seq") % 9 == 0, F.concat("row_key", F.lit("-x"))).otherwise(F.col("row_key"))
    label = F.when(F.col("seq") % 4 == 1, F.lower("corrected_label")).otherwise(F.col("corrected_label"))
    return rv.ignored_corrections(events_classified(spark, sf), c.select(key.alias("row_key"), label.alias("corrected_label"), "seq"))


CUSTOM_RULES = RuleSet(
    (CueRule("Open", ("not done", "not corrected", "unclear")), CueRule("Closed", ("done", "corrected", "resolved", "saved")),
     CueRule("Care", ("pain", "therapy", "patient"), overriding=True)),
    default_label="Rest",
)


def q_classify_custom_rules(spark, sf):
    """An own rule set whose phrases share words."""
    return classify(documents_keyed(spark, sf), rules=CUSTOM_RULES).select(ROW_KEY, *OUT)


def q_classify_ragged_csv(spark, sf):
    """S1 on a CSV with short and long rows (some with a blank last field before the
    surplus ones, some with separators inside quotes): nothing is lost unseen."""
    path = new_stage_path(spark, "ragged-csv")
    # one unquoted column: the writer puts its name, the header line, into every file
    dv.events_ragged_lines(spark, sf).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    listing = read_listing_csv(spark, path, on_long_rows="keep")
    out = classify(with_row_key(listing, id_col=C.query_id))
    return out.select(ROW_KEY, C.item, C.response, F.col(SURPLUS_COLUMN).isNotNull().alias("has_surplus"), *OUT)


def q_csv_round_trip(spark, sf):
    path = new_stage_path(spark, "csv-round-trip")
    write_csv(events_classified(spark, sf), path)
    return read_classified_csv(spark, path)


def q_export_by_category(spark, sf):
    path = new_stage_path(spark, "by-category")
    export_by_category(events_classified(spark, sf), path)
    return read_category_export(spark, path)


def q_classify_csv_listing(spark, sf):
    """S1-S3 end to end: the raw events listing written as CSV (quoted fields,
    a line break inside one answer) is read back with the listing reader (all
    strings, reader null tokens, long-row check) and classified."""
    path = new_stage_path(spark, "listing-csv")
    write_csv(dv.events_listing(spark, sf), path)
    listing = read_listing_csv(spark, path)
    return classify(with_row_key(listing, id_col=C.query_id))


def q_export_positions(spark, sf):
    return fl.export_positions(events_classified(spark, sf)).select(ROW_KEY, IS_VALID, LABEL, "row_pos")


def q_stratified_key_sample(spark, sf):
    fr = {"ALPHA-01": 0.1, "BETA-00": 0.5}
    return fl.key_sample(events_classified(spark, sf), 0.25, C.study, fr, seed=11)


def _events_stream(spark, sf):
    schema = dv.table(spark, sf, "events").schema
    ev = st.read_parquet_stream(spark, sf, schema, glob="events.parquet")
    return with_row_key(normalise_null_tokens(dv.events_to_listing(ev)), id_col=C.query_id)


def q_stream_classify(spark, sf):
    return st.run_to_table(spark, st.classify_stream(_events_stream(spark, sf)))


def q_stream_apply_corrections(spark, sf):
    """R3 on a stream: the classified event stream left-joined with the static
    corrections table (a stream-static join, no state), run to a table."""
    classified = st.classify_stream(_events_stream(spark, sf))
    fixed = rv.apply_corrections(classified, dv.events_corrections(spark, sf))
    return st.run_to_table(spark, fixed, "stream-corrected")


def q_stream_category_counts(spark, sf):
    return st.run_counts_to_table(spark, st.classify_stream(_events_stream(spark, sf)))


def q_export_positions_input(spark, sf):
    """L5/U1 in input order: places are taken at the scan, stored with the classified rows, and
    turned into positions without a sort over the table."""
    e = with_place(dv.table(spark, sf, "lineitem"))
    listing = normalise_null_tokens(dv.lineitem_to_listing(e, (PLACE,)))
    classified = stage(classify(listing).select(C.query_id, IS_VALID, LABEL, PLACE), "placed")
    return fl.input_export_positions(classified).select(C.query_id, IS_VALID, LABEL, "row_pos")


def q_alert_report(spark, sf):
    return an.alert_report(events_classified(spark, sf), k=3)


def events_timed(spark: SparkSession, sf: str) -> DataFrame:
    """Classified events listing with the event's time."""
    e = dv.table(spark, sf, "events")
    return classify(normalise_null_tokens(dv.events_to_listing(e, ("ts",))))


def q_consistent_sites(spark, sf):
    timed = stage(events_timed(spark, sf).select(C.site, LABEL, "ts"), "events-timed")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    return an.consistently_confused_sites(timed, day, rate=0.25, runs=3)


def q_exact_study_sample(spark, sf):
    return fl.exact_sample(events_classified(spark, sf), 40, C.study, seed=5)


def q_merge_corrections(spark, sf):
    """R3 as a merge: the classified listing stored by label, corrected part by part."""
    table = LabelTable(spark, new_stage_path(spark, "label-table"))
    table.create(events_classified(spark, sf))
    table.merge(dv.events_corrections(spark, sf))
    return table.read()


def q_column_fill(spark, sf):
    return column_fill(events_keyed(spark, sf).drop(C.original_query))


OWN_ROLES = ListingColumns(response="Reply text", item="Form", query_id="No", study="Trial", original_query="Asked", site="Centre")


def q_classify_own_roles(spark, sf):
    """A listing with headers of its own, from validation to breakdown."""
    e = events_keyed(spark, sf)
    renamed = e.withColumnsRenamed(dict(zip(C.roles().values(), OWN_ROLES.roles().values())))
    return an.study_category_counts(stage(classify(renamed, OWN_ROLES).select("Trial", LABEL), "own-roles"), OWN_ROLES)


def q_stream_window_alerts(spark, sf):
    """D1 over event time: a windowed aggregate with a watermark on the classified stream."""
    schema = dv.table(spark, sf, "events").schema
    ev = st.read_parquet_stream(spark, sf, schema, glob="events.parquet")
    classified = classify(normalise_null_tokens(dv.events_to_listing(ev, ("ts",))))
    return st.run_alerts_to_table(spark, st.windowed_alerts(classified, "ts", "1 day"))


def q_stream_deciding_corrections(spark, sf):
    """Corrections as a stream, folded into one deciding correction for each row."""
    schema = dv.table(spark, sf, "events").schema
    ev = st.read_parquet_stream(spark, sf, schema, glob="events.parquet")
    return st.run_corrections_to_table(spark, dv.events_to_corrections(ev))


def q_classify_category_table(spark, sf):
    """M12 with the categories and phrases of the default rule set as tables, over documents."""
    phrases, categories = rule_tables(spark, DEFAULT_RULES)
    return classify_by_table(documents_keyed(spark, sf), phrases, categories).select(ROW_KEY, *OUT)


def q_noise_documents(spark, sf):
    """D3, learned: transitions of all texts, and which texts read unlike the rest."""
    docs = dv.documents_with_noise(spark, sf)
    learned = learn_transitions(docs, "text")
    scored = docs.select("doc_id", "planted", learned.score("text").alias("s"))
    return scored.select("doc_id", "planted", "s.pairs", "s.total", learned.tells_noise(F.col("s")).alias("noise"))


def q_open_prompts(spark, sf):
    """M4 with a memory: which prompts are still to be asked when a ledger holds the replies to about half of them."""
    prompts = with_digest(build_prompts(batch_rows(validate(events_keyed(spark, sf)), C, MODEL_BATCH, bucket_by=C.query_id, bucket_rows=MODEL_BUCKET_ROWS)))
    ledger = prompts.where(F.col("digest") < "8").select("digest")
    still = open_prompts(prompts, ledger).select("digest", F.char_length("prompt").cast("long").alias("n_chars"))
    return still


def _scoped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query inside a stage scope: it leaves no stage folder but those its result reads."""
    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with stage_scope(spark) as scope:
            return scope.keep(query(spark, sf))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "validate_rows": q_validate_rows,
    "validity_counts": q_validity_counts,
    "classify_rules": q_classify_rules,
    "classify_documents": q_classify_documents,
    "classify_lineitem": q_classify_lineitem,
    "classify_conversations": q_classify_conversations,
    "row_keys_lineitem": q_row_keys_lineitem,
    "listing_profile": q_listing_profile,
    "listing_preview": q_listing_preview,
    "category_counts": q_category_counts,
    "category_counts_documents": q_category_counts_documents,
    "category_counts_json": q_category_counts_json,
    "validate_documents_strict": q_validate_documents_strict,
    "category_cards": q_category_cards,
    "results_header": q_results_header,
    "top_confused_items": q_top_confused_items,
    "top_confused_items_15": q_top_confused_items_15,
    "top_confused_sources": q_top_confused_sources,
    "confidence_histogram": q_confidence_histogram,
    "confidence_histogram_documents": q_confidence_histogram_documents,
    "study_category_pivot": q_study_category_pivot,
    "study_category_counts": q_study_category_counts,
    "study_category_pivot_lineitem": q_study_category_pivot_lineitem,
    "confidence_histogram_lineitem": q_confidence_histogram_lineitem,
    "medical_listing": q_medical_listing,
    "filtered_rows": q_filtered_rows,
    "filtered_rows_low": q_filtered_rows_low,
    "filtered_rows_medium": q_filtered_rows_medium,
    "filter_options": q_filter_options,
    "shown_of_total": q_shown_of_total,
    "review_queue": q_review_queue,
    "review_queue_all": q_review_queue_all,
    "pending_corrections": q_pending_corrections,
    "apply_corrections": q_apply_corrections,
    "label_agreement": q_label_agreement,
    "confusion_alert": q_confusion_alert,
    "site_confusion": q_site_confusion,
    "affirmative_worklist": q_affirmative_worklist,
    "summary_bundle": q_summary_bundle,
    "summary_text": q_summary_text,
    "prompt_batches": q_prompt_batches,
    "parse_replies": q_parse_replies,
    "model_results": q_model_results,
    "confused_rows": q_confused_rows,
    "pending_corrections_all": q_pending_corrections_all,
    "ignored_corrections": q_ignored_corrections,
    "classify_custom_rules": q_classify_custom_rules,
    "classify_ragged_csv": q_classify_ragged_csv,
    "csv_round_trip": q_csv_round_trip,
    "export_by_category": q_export_by_category,
    "classify_csv_listing": q_classify_csv_listing,
    "export_positions": q_export_positions,
    "stratified_key_sample": q_stratified_key_sample,
    "stream_classify": q_stream_classify,
    "stream_category_counts": q_stream_category_counts,
    "stream_apply_corrections": q_stream_apply_corrections,
    "export_positions_input": q_export_positions_input,
    "alert_report": q_alert_report,
    "consistent_sites": q_consistent_sites,
    "exact_study_sample": q_exact_study_sample,
    "merge_corrections": q_merge_corrections,
    "column_fill": q_column_fill,
    "classify_own_roles": q_classify_own_roles,
    "stream_window_alerts": q_stream_window_alerts,
    "stream_deciding_corrections": q_stream_deciding_corrections,
    "classify_category_table": q_classify_category_table,
    "noise_documents": q_noise_documents,
    "open_prompts": q_open_prompts,
}
QUERIES = {name: _scoped(query) for name, query in QUERIES.items()}

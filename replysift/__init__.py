"""replysift: triage of free-text answers in request/response listings on Spark.

Public entry points (all DataFrame -> DataFrame, no actions unless noted):

* ``read_listing_csv``, ``with_row_key``       sources (S1-S7, row identity)
* ``classify``                                 validity + native rule scorer
* ``classify_with_model``                      batched external model (M1-M9)
* ``category_counts`` ... ``site_confusion``   analytics (A2-A11, D1, D2)
* ``filter_results`` ... ``stratified_sample`` filters and listings (P6-P16, D6)
* ``review_queue`` ... ``affirmative_worklist`` review loop (R1-R3, D4, D5)
* ``write_csv``, ``export_by_category``, ``stage`` sinks (S8-S11)
"""

from .config import (  # noqa: F401
    CATEGORIES, DEFAULT_COLUMNS, DEFAULT_RULES, CueRule, ListingColumns, RuleSet,
)
from .operators.analytics import (  # noqa: F401
    category_cards, category_counts, confidence_histogram, confusion_alerts, results_header,
    site_confusion, study_category_counts, study_category_pivot, summary_bundle, top_items,
    valid_only,
)
from .operators.classify import classify, stamp_results, validate, validity_counts  # noqa: F401
from .operators.filters import (  # noqa: F401
    confidence_band, confused_rows, export_order, export_positions, filter_options, filter_results,
    low_confidence,
    key_sample, medical_listing, review_preview, sample_listing, shown_of_total, stratified_sample,
)
from .operators.model_batch import (  # noqa: F401
    batch_rows, build_prompts, call_model, classify_with_model, match_results, parse_reply,
)
from .operators.review import (  # noqa: F401
    affirmative_worklist, apply_corrections, label_agreement, latest_corrections,
    pending_corrections, review_page, review_queue,
)
from .operators.summary import summary_text  # noqa: F401
from .sources.listing import (  # noqa: F401
    check_columns, is_unique, listing_profile, normalise_null_tokens, preview_rows,
    read_listing_csv, with_row_key,
)
from .sources.sinks import (  # noqa: F401
    export_by_category, read_category_export, read_classified_csv, stage, stage_root, write_csv,
)

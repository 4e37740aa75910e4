"""Print the formatted physical plans of the headline queries (evidence for
pushdown, pruning, partial aggregation and the absence of Python in the hot
path). ``python tools/show_plans.py [sf_dir] > docs/plans.txt``"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(sf: str) -> None:
    from replysift.operators import analytics as an
    from replysift.operators import filters as fl
    from replysift.operators import review as rv
    from replysift.operators.model_batch import batch_rows, build_prompts
    from replysift.operators.classify import classify, validate
    from replysift.plans import queries as q
    from replysift.session import local_session
    from replysift.sources import derived as dv

    spark = local_session(8)
    ev = q.events_classified(spark, sf)
    shown = {
        "classify (events listing -> classified rows; the exchanges are the check for shared ids, the scoring is narrow)":
            classify(q.events_keyed(spark, sf)),
        "category_counts over the stage table (pushed filters, partial + final aggregate)":
            an.category_counts(ev),
        "confidence_histogram (one scalar subquery, no join with the data)":
            an.confidence_histogram(ev),
        "study_category_pivot (pivot with given values)": an.study_category_pivot(ev),
        "top_confused_items (take-ordered top-k)": an.top_items(ev, q.C, "Confused", 10),
        "apply_corrections (one maximum per key, equi left join on row_key; AQE picks the join)":
            rv.apply_corrections(ev, dv.events_corrections(spark, sf)),
        "row keys for a listing with repeated rows (salted ordinals; group sizes by partial aggregate)":
            q.lineitem_keyed(spark, sf),
        "prompts (hashed buckets, one prompt per batch)":
            build_prompts(batch_rows(validate(q.events_keyed(spark, sf)), q.C, q.MODEL_BATCH)),
        "export positions (range partitions checkpointed once, local index + broadcast per-partition offsets)":
            fl.export_positions(ev),
    }
    for title, df in shown.items():
        print("=" * 100)
        print(title)
        print("=" * 100)
        df._jdf.queryExecution().explainString  # noqa: B018  (plan is built lazily)
        print(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")

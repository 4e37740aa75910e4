"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .gbt_quality import q_gbt_quality
from .hard_negatives import q_hard_negatives
from .license_scan import q_license_scan, q_license_scan_planted
from .line_dedup import q_line_dedup, q_line_dedup_reversed
from .minhash_join import q_minhash_near_dedup
from .mixing import q_mixing
from .partenum_join import q_partenum_join
from .quality_rules import q_quality_rules
from .sentencepiece_backend import q_sentencepiece
from .token_records import q_token_records
from .toxicity import q_toxicity
from .turn_repair import q_conversation_repair
from .winnow import q_winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": q_toxicity,
    "op2_mixing": q_mixing,
    "op3_gbt_quality": q_gbt_quality,
    "op4_token_records": q_token_records,
    "op5_partenum_join": q_partenum_join,
    "op6_sentencepiece": q_sentencepiece,
    "op7_quality_rules": q_quality_rules,
    "op8_license_scan": q_license_scan,
    "license_scan_planted": q_license_scan_planted,
    "op9_line_dedup": q_line_dedup,
    "line_dedup_reversed": q_line_dedup_reversed,
    "op10_winnow": q_winnow,
    "op11_minhash_near_dedup": q_minhash_near_dedup,
    "op12_hard_negatives": q_hard_negatives,
    "op13_conversation_repair": q_conversation_repair,
}

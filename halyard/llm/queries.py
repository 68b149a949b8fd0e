"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontamination, jaccard_join, substrings, warc
from .katz import op1_katz
from .packing import op3_packing
from .pii import op8_pii
from .quality_classifier import op7_quality_classifier
from .quality_rules import op10_quality_rules
from .toxicity import op5_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_katz, decontamination.op2_decontamination, op3_packing, substrings.op4_substring_dedup, op5_toxicity, jaccard_join.op6_jaccard_join, op7_quality_classifier, op8_pii, warc.op9_warc, op10_quality_rules)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontamination.ORACLE_SQL, "op4_substring_dedup": substrings.ORACLE_SQL, "op6_jaccard_join": jaccard_join.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL}

"""Queries and SQL of this package, by name."""

from __future__ import annotations

from .decontam import OP5_SQL, op5_decontaminate
from .langid import op3_language_id
from .line_dedup import OP2_SQL, op2_line_dedup
from .lm import op1_lm_score
from .mixing import OP7_SQL, op7_mix_sources
from .pii import op10_pii
from .quality import op6_quality
from .simhash import op9_simhash
from .substring import op8_substring_dedup
from .topk import OP4_SQL, op4_top_k


def queries() -> dict:
    return {
        "op1_lm_score": op1_lm_score,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_top_k": op4_top_k,
        "op5_decontaminate": op5_decontaminate,
        "op6_quality": op6_quality,
        "op7_mix_sources": op7_mix_sources,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_simhash": op9_simhash,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_top_k": OP4_SQL, "op5_decontaminate": OP5_SQL, "op7_mix_sources": OP7_SQL}

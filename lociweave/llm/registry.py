"""The corpus operators' queries and SQL."""

from __future__ import annotations

from .op1_suffix_dedup import op1_suffix_dedup
from .op2_toxicity import op2_toxicity
from .op3_secrets import op3_secret_scans
from .op4_decontaminate import OP4_SQL, op4_decontamination
from .op5_substring_dedup import op5_substring_dedup
from .op6_packing import op6_packing
from .op7_neighbours import OP7_SQL, op7_nearest_neighbours
from .op8_jaccard import op8_jaccard_join
from .op9_sharding import op9_sharding
from .op10_language import op10_language_id


def queries() -> dict:
    found = [
        op1_suffix_dedup, op2_toxicity, op3_secret_scans, op4_decontamination, op5_substring_dedup,
        op6_packing, op7_nearest_neighbours, op8_jaccard_join, op9_sharding, op10_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op7_nearest_neighbours": OP7_SQL}

"""The queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .edit_embedding import op4_edit_embedding
from .language_model import op1_language_model
from .license_scan import ORACLE_3, op3_license_scan
from .line_quality import op9_line_quality
from .mixing import ORACLE_6, op6_mixing
from .packing import op2_related_packing
from .quality_rules import op10_quality_rules
from .sharding import ORACLE_7, op7_sharding
from .simhash import op5_simhash
from .substring_dedup import ORACLE_8, op8_substring_dedup

QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_related_packing": op2_related_packing,
    "op3_license_scan": op3_license_scan,
    "op4_edit_embedding": op4_edit_embedding,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_quality": op9_line_quality,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES = {"op3_license_scan": ORACLE_3, "op6_mixing": ORACLE_6, "op7_sharding": ORACLE_7, "op8_substring_dedup": ORACLE_8}

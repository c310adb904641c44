"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .langid import op5_langid
from .media import op1_webp_media
from .mixing import op8_curriculum_mix
from .packing import op2_best_fit_packing
from .quality_mil import op3_quality_mil
from .simhash import op4_simhash_bktree
from .token_scan import op6_token_scan
from .toxicity import op7_ordinal_toxicity
from .url_rules import OP10_SQL, op10_url_rules
from .weak_rules import op9_weak_rules

QUERIES = {
    "op1_webp_media": op1_webp_media,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_mil": op3_quality_mil,
    "op4_simhash_bktree": op4_simhash_bktree,
    "op5_langid": op5_langid,
    "op6_token_scan": op6_token_scan,
    "op7_ordinal_toxicity": op7_ordinal_toxicity,
    "op8_curriculum_mix": op8_curriculum_mix,
    "op9_weak_rules": op9_weak_rules,
    "op10_url_rules": op10_url_rules,
}
ORACLE_SQL = {"op10_url_rules": OP10_SQL}

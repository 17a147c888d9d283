"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import decontaminate, dialogues, exact, jaccard, language, negatives, packing, pages, privacy, sharding, squares, substrings, suffixes

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_language_id": language.op4_language_id,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_html_extraction": pages.op7_html_extraction,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_pii": privacy.op9_pii,
    "op10_sharding": sharding.op10_sharding,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_conversation_repair": dialogues.op12_conversation_repair,
    "op13_squares_packing": squares.op13_squares_packing,
}
ORACLES = {
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op5_suffix_dedup": suffixes.OP5_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op8_exact_dedup": exact.OP8_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}

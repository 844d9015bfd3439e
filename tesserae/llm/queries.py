"""The training-data queries by name, and SQL for those it can express."""

from __future__ import annotations

from . import decontaminate, language, packing, quality, repeats, reshard, simhash, spotsigs, tokenfiles, toxicity

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_reshard": reshard.op3_reshard,
    "op4_language": language.op4_language,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_tokenfiles": tokenfiles.op10_tokenfiles,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.OP5_SQL,
}

"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from tessella.llm import exact_dedup, language_model, line_quality, line_templates, mixing, ngram_join, packing, personal_data, sharding, toxicity


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_line_templates": line_templates.op2_line_templates,
        "op2_long_line_templates": line_templates.op2_long_line_templates,
        "op3_mixing": mixing.op3_mixing,
        "op4_line_quality": line_quality.op4_line_quality,
        "op5_packing": packing.op5_packing,
        "op6_personal_data": personal_data.op6_personal_data,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_language_model": language_model.op8_language_model,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_templates": line_templates.OP2_SQL, "op3_mixing": mixing.OP3_SQL, "op9_ngram_join": ngram_join.OP9_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL}

"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tracegrain.llm import annperm, bpe, decontam, fmdedup, langid, mixing, ngramjoin, pqcodes, preferences, resampling, secrets, toxicity, tput


def queries() -> dict:
    return {
        "op1_importance_resampling": resampling.op1_importance_resampling,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_ngram_join": ngramjoin.op3_ngram_join,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_preferences": preferences.op5_preferences,
        "op6_permutation_index": annperm.op6_permutation_index,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_decontaminate": decontam.op8_decontaminate,
        "op9_language_id": langid.op9_language_id,
        "op10_substring_dedup": fmdedup.op10_substring_dedup,
        "op11_ranked_search": tput.op11_ranked_search,
        "op12_source_mix": mixing.op12_source_mix,
        "op13_vector_codes": pqcodes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_preferences": preferences.OP5_SQL, "op11_ranked_search": tput.OP11_SQL, "op12_source_mix": mixing.OP12_SQL, "op13_vector_codes": pqcodes.OP13_SQL}

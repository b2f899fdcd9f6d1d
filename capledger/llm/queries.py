"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, language_id, lm_scoring, manifest, mixing, packing, quality_classifier, quality_rules, resampling, secrets, simhash, url_filter


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_language_id": language_id.op3_language_id,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_mixing": mixing.op5_mixing,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_packing": packing.op7_packing,
        "op8_secrets": secrets.op8_secrets,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_manifest": manifest.op11_manifest,
        "op12_resampling": resampling.op12_resampling,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op3_language_id": language_id.SQL, "op5_mixing": mixing.SQL, "op6_jaccard_join": jaccard_join.SQL, "op10_url_filter": url_filter.SQL, "op11_manifest": manifest.SQL, "op12_resampling": resampling.SQL}

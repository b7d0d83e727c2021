"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, licenses, line_dedup, mixing, ngram_join, packing, periodic, pii, quality, resampling, secrets, simhash, toxicity


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_mixing": mixing.op3_mixing,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_packing": packing.op5_packing,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_secrets": secrets.op7_secrets,
        "op8_licenses": licenses.op8_licenses,
        "op9_pii": pii.op9_pii,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_resampling": resampling.op12_resampling,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.SQL, "op3_mixing": mixing.SQL, "op6_exact_dedup": exact_dedup.SQL, "op10_line_dedup": line_dedup.SQL, "op12_resampling": resampling.SQL}

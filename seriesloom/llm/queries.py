"""The corpus operators' queries and SQL, as registered for the driver."""

from __future__ import annotations

from . import decontaminate, divergence, jaccard, langid, linededup, mixing, ngramlm, quality, substring, tokenfile


def queries() -> dict:
    found = (
        substring.op1_substring_dedup, divergence.op2_distribution_divergence, decontaminate.op3_decontaminate_templates, tokenfile.op4_token_file, jaccard.op5_jaccard_join, ngramlm.op6_kneser_ney,
        langid.op7_language_id, linededup.op8_line_dedup, quality.op9_quality_classifier, mixing.op10_mix_curriculum,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring.ORACLE_SQL, "op5_jaccard_join": jaccard.ORACLE_SQL, "op8_line_dedup": linededup.ORACLE_SQL, "op10_mix_curriculum": mixing.ORACLE_SQL}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language_id, lm_score, ngram_join, packing, poisson_mix, token_count, toxicity, warc, webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity_pu": toxicity.op1_toxicity_pu,
        "op2_warc_zstd": warc.op2_warc_zstd,
        "op3_lm_lattice": lm_score.op3_lm_lattice,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_poisson_mix": poisson_mix.op6_poisson_mix,
        "op7_language_id": language_id.op7_language_id,
        "op8_lossless_webp": webp.op8_lossless_webp,
        "op9_ngram_jaccard": ngram_join.op9_ngram_jaccard,
        "op10_token_count": token_count.op10_token_count,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_zstd": warc.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op6_poisson_mix": poisson_mix.ORACLE}

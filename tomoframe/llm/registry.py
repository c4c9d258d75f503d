"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomoframe.llm import exact_dedup, html_extract, lexical_search, licenses, lm_scoring, ngram_join, ordinal_quality, packing, periodic_runs, pieces, quality_rules, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_balanced_label_propagation": sharding.op2_balanced_label_propagation,
        "op3_ordinal_quality": ordinal_quality.op3_ordinal_quality,
        "op4_subsequence_kernel_svm": toxicity.op4_subsequence_kernel_svm,
        "op5_token_group_matrix": ngram_join.op5_token_group_matrix,
        "op6_recurrent_block_labeller": html_extract.op6_recurrent_block_labeller,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_bounded_space_packing": packing.op8_bounded_space_packing,
        "op9_sentencepiece_agenda": pieces.op9_sentencepiece_agenda,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_periodic_runs": periodic_runs.op11_periodic_runs,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_log_frequency_bloom": lm_scoring.op13_log_frequency_bloom,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op7_license_scan": licenses.SQL, "op10_exact_dedup": exact_dedup.SQL, "op12_lexical_search": lexical_search.SQL}

"""The queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, hard_negatives, jaccard_join, langid, licenses, mixing, packing, pii, prefix_trie, quality_rules, substring_dedup, warc, weak_labels


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline.py, imported when they run: without that file the operators are still there."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_language_id": langid.query,
        "op2_quality_classifier": weak_labels.query,
        "op3_license_scan": licenses.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_ngram_jaccard_join": jaccard_join.query,
        "op6_warc": warc.query,
        "op7_best_fit_packing": packing.query,
        "op8_quality_rules": quality_rules.query,
        "op8_quality_base_counts": quality_rules.query_base,
        "op9_pfair_mixing": mixing.query,
        "op9_pfair_mixing_whole": mixing.query_whole,
        "op10_substring_dedup": substring_dedup.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_pii_sanitisation": pii.query,
        "op13_prefix_trie": prefix_trie.query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op6_warc": warc.ORACLE, "op8_quality_base_counts": quality_rules.ORACLE_BASE, "op9_pfair_mixing": mixing.ORACLE, "op9_pfair_mixing_whole": mixing.ORACLE_WHOLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}

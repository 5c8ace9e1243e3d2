"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontamination, html_text, language_id, neighbour_graph, packing, quality_classifier, quality_rules, sharding, simhash, token_shards, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_language_id": language_id.op2_language_id,
        "op3_sharding": sharding.op3_sharding,
        "op4_simhash": simhash.op4_simhash,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_token_shards": token_shards.op7_token_shards,
        "op8_warc": warc.op8_warc,
        "op9_html_extraction": html_text.op9_html_extraction,
        "op10_quality_classifier": quality_classifier.op10_quality_classifier,
        "op11_near_dedup": neighbour_graph.op11_near_dedup,
        "op12_whitening": whitening.op12_whitening,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.sql(), "op8_warc": warc.SQL}

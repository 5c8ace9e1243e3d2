"""A training corpus from raw documents: five stages, each one operator of ``riskweave.llm``.

Every stage gets what its predecessor kept, written as Parquet in the shared folder and
read again. All stages but the last return the columns of documents; the last one returns
the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import decontamination, language_id, packing, quality_rules, simhash
from riskweave.llm.common import table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("language_id", language_id.stage),
    ("simhash_near_dedup", simhash.stage),
    ("decontamination", decontamination.stage),
    ("best_fit_packing", packing.stage),
]

#: Trained filters, fingerprints and a byte-level vocabulary are not SQL; tests/llm holds the
#: stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name}")
    return docs

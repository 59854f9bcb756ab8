"""The corpus pipeline: quality, near copies, repeated spans, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lookalike.llm.common import settled, table
from lookalike.llm.inverted import stage_decontaminate
from lookalike.llm.packing import stage_packing
from lookalike.llm.quality import stage_quality
from lookalike.llm.simhash import stage_simhash
from lookalike.llm.suffix_dedup import stage_suffix_dedup

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before it kept.
STAGES = [
    ("quality_classifier", stage_quality),
    ("simhash_near_dedup", stage_simhash),
    ("suffix_array_dedup", stage_suffix_dedup),
    ("benchmark_decontamination", stage_decontaminate),
    ("best_fit_packing", stage_packing),
]

#: No stage but the fourth has an SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

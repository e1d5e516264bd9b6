"""The corpus pipeline: quality rules, exact and near deduplication, mixing to weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import documents, drop, released, stored
from millrace.llm.exact_dedup import dedup_stage
from millrace.llm.mixing import mixing_stage
from millrace.llm.packing import packing_stage
from millrace.llm.quality_rules import quality_stage
from millrace.llm.simhash import simhash_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Subword ids and fingerprints are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written as Parquet and read by the next."""
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        # What a stage stores for itself goes with it, and its input once its output is written.
        with released() as kept:
            out = stored(stage(spark, docs, sf_dir))
            kept.append(out)
        if last is not None:
            drop(last)
        docs = last = out
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages from raw documents to shards.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its
predecessor kept; ``run`` writes every stage's rows as Parquet in the shared
checkpoint folder and rereads them, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlab.llm.common import load, saved
from seqlab.llm.decontaminate import decontaminate
from seqlab.llm.mixing import mix_documents
from seqlab.llm.quality_rules import quality_filter
from seqlab.llm.sharding import op8_sharding
from seqlab.llm.simhash import simhash_dedup
from seqlab.session import ship_package


def _stage(operator):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(spark, docs, sf_dir)
    return run_stage


STAGES = [
    ("quality_rules", _stage(lambda spark, docs, sf_dir: quality_filter(docs))),
    ("simhash_near_dedup", _stage(lambda spark, docs, sf_dir: simhash_dedup(docs))),
    ("benchmark_decontamination", _stage(lambda spark, docs, sf_dir: decontaminate(docs, load(spark, sf_dir, "benchmark")))),
    ("mixing", _stage(lambda spark, docs, sf_dir: mix_documents(docs))),
    ("sharding", _stage(lambda spark, docs, sf_dir: op8_sharding(docs))),
]

#: SQL has no XXH64 and no seeded draws, so the stages are tested against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus pipeline: language ID, exact dedup, near dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treesync.llm import corpus
from treesync.llm.common import stage, table

STAGES = [
    ("language", corpus.language),
    ("exact_dedup", corpus.exact),
    ("near_dedup", corpus.near),
    ("pii", corpus.private),
    ("packing", corpus.packed),
]

#: SQL can't express models, tokens and packing; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

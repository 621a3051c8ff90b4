"""The stages of the corpus pipeline; each takes and returns documents, but for the last.

Nulls in any column, empty and very long texts, ties and repeated rows are handled as the operator of the stage states.
Empty tables give empty tables. Columns beside doc_id, text and lang are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm import exact_dedup, jaccard_join, langid, packing, pii
from treesync.llm.common import small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; ``lang`` becomes the predicted one. Null, empty and letterless texts are rejected."""
    small_batches(spark)
    name = "language"
    while name in docs.columns:
        name += "_"
    found = langid.identify(docs, langid.fit(docs), name).where(f"not {name}.rejected")
    return found.select(*(F.col(f"{name}.lang").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest doc_id; null and empty texts are one group."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of smallest doc_id; texts without words and null ids stay."""
    return jaccard_join.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked, disclosing terms generalised or removed; ``n_chars`` follows the text."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens; a null text is one piece with the end token."""
    return packing.pack(docs)

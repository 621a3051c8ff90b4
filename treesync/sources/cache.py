"""The hash cache: a table by path, with size and time of the content that was hashed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.functions.hashing import valid


def decodable(cache: DataFrame) -> DataFrame:
    """Rows of a known algorithm and its length of digest (``hash`` binary)."""
    return cache.where(valid(F.col("algo"), F.col("hash")))


def read(spark: SparkSession, name: str) -> DataFrame:
    return decodable(spark.table(name))


def write(cache: DataFrame, name: str, buckets: int = 64) -> None:
    """A table bucketed by path, so that lookups by path don't shuffle it again: a file a bucket, sorted."""
    cache.repartition(buckets, "path").write.mode("overwrite").bucketBy(buckets, "path").sortBy("path").saveAsTable(name)


def renew(spark: SparkSession, name: str, new: DataFrame, order: list[str], buckets: int = 64) -> str:
    """Merge ``new`` rows into the table ``name``, the last of each path staying, and return the name of the table that has the result.

    Written beside the old table, which readers may still use; the old side isn't shuffled, as its buckets are the join's.
    """
    old = spark.table(name)
    rest = [c for c in old.columns if c != "path"]
    latest = new.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("new"))
    both = old.select("path", F.struct(*rest).alias("old")).join(latest, "path", "full")
    later = F.col("old").isNull() | (F.struct(*(F.col(f"new.{c}") for c in order)) >= F.struct(*(F.col(f"old.{c}") for c in order)))
    row = F.when(F.col("new").isNotNull() & later, F.col("new")).otherwise(F.col("old"))
    made = f"{name.rsplit('__', 1)[0]}__{uuid.uuid4().hex}"
    write(both.select("path", row.alias("row")).select("path", "row.*"), made, buckets)
    return made


def lookup(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``files`` with ``cached_hash`` and ``cache_hit``; an entry of another size or time, or an unknown one on either side, is a miss.

    Joined by path alone, which the cache has once: so a table that ``write`` made is read bucket by bucket, and only the
    files, narrow rows, are shuffled.
    """
    known = cache.select("path", F.struct(F.col("size").alias("size"), F.col("mtime").alias("mtime"), F.col("hash").alias("hash")).alias("__known"))
    same = (F.col("size") == F.col("__known.size")) & (F.col("modified_epoch") == F.col("__known.mtime"))
    out = files.join(known, "path", "left").withColumn("cached_hash", F.when(same, F.col("__known.hash")))
    return out.select(*files.columns, "cached_hash").withColumn("cache_hit", F.col("cached_hash").isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Both, but the row of the last order for each key. Partial maxima meet before the shuffle."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(key, *(f"last.{c}" for c in rest))


def evict(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The cache without paths that are gone from the source."""
    return cache.join(files.select("path"), "path", "left_semi")

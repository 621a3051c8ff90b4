"""A store that holds each content once, and the paths that refer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.functions.shared import staged


def split(planned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs, links) of a narrow plan; ``ref`` is the canonical path of a group, or the row's own path."""
    ref = F.when(F.col("role") == "duplicate", F.col("canonical_path")).otherwise(F.col("path"))
    return planned.where("role <> 'duplicate'").select(F.col("path").alias("ref"), "size"), planned.select("dest_path", ref.alias("ref"))


def write(planned: DataFrame, content: DataFrame, path: str, prefixes: int = 16) -> None:
    """Blobs by a prefix of a hash of their reference, links beside them.

    ``planned`` has no content, so what is shuffled for the plan stays narrow; ``content(path, content)`` is joined once.
    """
    blobs, links = split(planned)
    blobs = content.select(F.col("path").alias("ref"), "content").join(blobs, "ref")
    blobs.withColumn("prefix", F.pmod(F.xxhash64("ref"), F.lit(prefixes))).write.partitionBy("prefix").parquet(f"{path}/blobs")
    links.write.parquet(f"{path}/links")


#: Links of one reference that one row of content serves.
LINKS_A_COPY = 10_000


def joined(blobs: DataFrame, links: DataFrame, each: int = LINKS_A_COPY, chunk: int = 500) -> DataFrame:
    """dest_path, size, content of every link.

    Links travel in chunks of a reference, arrays of paths, and content is sent once for every ``each`` links of it: a file with a
    million links goes to a hundred tasks, one with few goes to one. Only then does a row a link appear, where it is used.
    """
    many = staged(links.groupBy("ref").agg(F.count("*").alias("weight")).where(F.col("weight") > each), "shared-references")  # at most one in ``each`` links
    copies = F.ceil(F.coalesce("weight", F.lit(1)) / each).cast("int")
    spread = links.join(F.broadcast(many), "ref", "left").select("ref", "dest_path", F.pmod(F.xxhash64("dest_path"), copies).cast("int").alias("copy"))
    packed = spread.groupBy("ref", "copy", F.pmod(F.xxhash64("dest_path", F.lit(1)), F.lit(max(1, each // chunk))).alias("chunk")).agg(F.collect_list("dest_path").alias("paths"))
    content = blobs.join(F.broadcast(many), "ref", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("weight")
    return packed.join(content, ["ref", "copy"]).select(F.explode("paths").alias("dest_path"), "size", "content")


def restore(spark: SparkSession, path: str) -> DataFrame:
    """dest_path, size, content of every path."""
    return joined(spark.read.parquet(f"{path}/blobs"), spark.read.parquet(f"{path}/links"))

"""Verification of what was copied, by the first check that fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(planned: DataFrame) -> DataFrame:
    """Physical copies with a known hash; files of a size of their own were never hashed and aren't verified."""
    return planned.where("role <> 'duplicate' and hash is not null")


def check(planned: DataFrame, dst: DataFrame) -> DataFrame:
    """dest_path, status {ok, missing_file, size_mismatch, io, hash_mismatch}, expected, actual of each candidate."""
    have = dst.select(F.col("path").alias("dest_path"), F.col("size").alias("d_size"), F.col("hash").alias("d_hash"), F.lit(True).alias("there"))
    joined = candidates(planned).join(have, "dest_path", "left")
    status = (
        F.when(F.col("there").isNull(), "missing_file").when(~F.col("size").eqNullSafe(F.col("d_size")), "size_mismatch").when(F.col("d_hash").isNull(), "io")
        .when(F.col("hash") != F.col("d_hash"), "hash_mismatch").otherwise("ok")
    )
    shown = lambda size, digest: F.when(F.col("status") == "size_mismatch", F.col(size).cast("string")).when(F.col("status") == "hash_mismatch", F.col(digest))
    return joined.withColumn("status", status).select("rel_path", "dest_path", "status", shown("size", "hash").alias("expected"), shown("d_size", "d_hash").alias("actual"))


def stats(checks: DataFrame, planned: DataFrame) -> DataFrame:
    """files_verified, files_failed, duplicates_skipped and the exit status (0 clean, 1 partial)."""
    flags = lambda df, ok, bad, dup: df.select(*(F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in (("ok", ok), ("bad", bad), ("dup", dup))))
    no = F.lit(False)
    rows = flags(checks, F.col("status") == "ok", F.col("status") != "ok", no).unionByName(flags(planned, no, no, F.col("role") == "duplicate"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = rows.agg(total("ok").alias("files_verified"), total("bad").alias("files_failed"), total("dup").alias("duplicates_skipped"))
    return out.withColumn("exit_status", F.when(F.col("files_failed") > 0, 1).otherwise(0))

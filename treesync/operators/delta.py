"""What changed between a source and a destination: one full outer join on the relative path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesync.functions.paths import relative


def _slim(files: DataFrame, root: str, side: str) -> DataFrame:
    return files.select(relative(F.col("path"), root).alias("rel_path"), F.col("size").alias(f"{side}_size"), F.col("modified_epoch").alias(f"{side}_mtime"), F.lit(True).alias(f"in_{side}"))


def _same():
    """Equal sizes and equal, known times; an unknown time on either side counts as changed."""
    return F.coalesce((F.col("s_size") == F.col("d_size")) & (F.col("s_mtime") == F.col("d_mtime")), F.lit(False))


def changed(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str, force: bool = False) -> DataFrame:
    """Source rows that must be copied; with ``force`` all of them."""
    if force:
        return src
    keyed = src.withColumn("rel_path", relative(F.col("path"), src_root))
    have = _slim(dst, dst_root, "d")
    joined = keyed.join(have, "rel_path", "left")
    same = F.coalesce((F.col("size") == F.col("d_size")) & (F.col("modified_epoch") == F.col("d_mtime")), F.lit(False))
    return joined.where(~same).select(*src.columns)


def orphans(src_all: DataFrame, dst: DataFrame, src_root: str, dst_root: str) -> DataFrame:
    """Destination rows without a source; the source is taken without excludes, and only paths under its root count."""
    known = src_all.where(F.col("path").startswith(src_root.rstrip("/") + "/")).select(relative(F.col("path"), src_root).alias("rel_path"))
    return dst.withColumn("rel_path", relative(F.col("path"), dst_root)).join(known, "rel_path", "left_anti").select(*dst.columns)


def mirror(src: DataFrame, dst: DataFrame, src_root: str, dst_root: str) -> DataFrame:
    """rel_path, status {new, changed, unchanged, orphan} and both sizes, in one shuffle of narrow rows; an unknown size is a change, not an absence."""
    both = _slim(src, src_root, "s").join(_slim(dst, dst_root, "d"), "rel_path", "full_outer")
    status = F.when(F.col("in_s").isNull(), "orphan").when(F.col("in_d").isNull(), "new").when(_same(), "unchanged").otherwise("changed")
    return both.select("rel_path", status.alias("status"), "s_size", "d_size")


def apply_deletes(dst: DataFrame, gone: DataFrame) -> DataFrame:
    return dst.join(gone.select("path"), "path", "left_anti")


def counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("files"), F.sum(F.coalesce("s_size", "d_size")).alias("bytes"))

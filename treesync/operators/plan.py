"""Transfer plans: what is copied, what is linked, how, and whether it fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesync.functions.paths import dirname, link_target, to_dest
from treesync.operators import scans
from treesync.schemas import LAST


def size_class(size: Column, threshold: int = 1 << 20) -> Column:
    return F.when(size < threshold, "small").otherwise("large")


def mode_octal(mode: Column) -> Column:
    """Permission bits in octal; 0 means unknown and gives null, to be inherited from the source."""
    return F.conv(F.nullif(mode.bitwiseAND(0o777), F.lit(0)).cast("string"), 10, 8)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def rfc3339(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def copy_set(planned: DataFrame) -> DataFrame:
    return planned.where("role <> 'duplicate'")


def totals(planned: DataFrame) -> DataFrame:
    copies = F.col("role") == "duplicate"
    return planned.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if(copies).alias("link_count"),
        F.coalesce(F.sum(F.when(~copies, F.col("size"))), F.lit(0)).alias("physical_bytes"),
    )


def dry_run(planned: DataFrame) -> DataFrame:
    copies = F.col("role") == "duplicate"
    return planned.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if(copies).alias("links"),
        F.coalesce(F.sum(F.when(copies, F.col("size"))), F.lit(0)).alias("bytes_saved"),
    )


def physical_order(files: DataFrame) -> DataFrame:
    """Globally sorted by physical offset, unknown ones last, then path: a range exchange, no single task."""
    return files.orderBy(F.asc_nulls_last("physical_offset"), "path")


def with_index(files: DataFrame, name: str = "plan_idx") -> DataFrame:
    """``files`` with their 0-based position in physical order; one range exchange, and rows stay in their partitions."""
    return scans.position(files, [], [F.coalesce("physical_offset", F.lit(LAST)), "path"], name)


def index_within(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` with their 0-based position in their group; a large group is spread over range partitions."""
    return scans.position(rows, [group], [order], name)


def links(planned: DataFrame, src_root: str, dst_root: str) -> DataFrame:
    """Each duplicate with the destination of its canonical file and the relative link target."""
    target = to_dest(F.col("canonical_path"), src_root, dst_root)
    return planned.where("role = 'duplicate'").select(
        "path", "dest_path", target.alias("canonical_dest"), link_target(target, dirname(F.col("dest_path"))).alias("link_target"), "size"
    )


def with_volume(rows: DataFrame, path: str, volumes: DataFrame, name: str) -> DataFrame:
    """``rows`` with the longest of ``volumes(volume, ...)`` that holds the column ``path``, by whole components; null if none does.

    One left join for each depth at which there are volumes, deepest first: Spark broadcasts a short list and shuffles a
    long one, and only the depths, a few small numbers, come to the driver. A volume '/' holds every absolute path.
    """
    known = volumes.select(F.regexp_replace("volume", "(?<=.)/+$", "").alias("__volume")).where("__volume is not null").distinct()
    known = known.withColumn("__depth", F.when(F.col("__volume") == "/", 1).otherwise(F.size(F.split("__volume", "/"))))
    out, parts = rows.withColumn(name, F.lit(None).cast("string")), F.split(F.col(path), "/")
    for row in sorted(known.select("__depth").distinct().collect(), reverse=True):
        depth = row["__depth"]
        here = known.where(F.col("__depth") == depth).select(F.col("__volume"), F.when(F.col("__volume") == "/", "").otherwise(F.col("__volume")).alias("__above"))
        above = F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))
        out = out.withColumn("__above", above).join(here, "__above", "left").withColumn(name, F.coalesce(name, "__volume")).drop("__above", "__volume")
    return out


def link_method(linked: DataFrame, volumes: DataFrame, strategy: str = "hardlink", cow: bool = False, symlinks: bool = True) -> DataFrame:
    """``method`` of each link: cloned, linked (same volume), symlinked, or fallback_copied, whose bytes are written."""
    placed = with_volume(with_volume(linked, "dest_path", volumes, "__at"), "canonical_dest", volumes, "__of")
    same = F.coalesce(F.col("__at") == F.col("__of"), F.lit(False))
    method = F.when(F.lit(strategy == "clone" and cow), "cloned").when(same, "linked").when(F.lit(symlinks), "symlinked").otherwise("fallback_copied")
    out = placed.withColumn("method", method).drop("__at", "__of")
    return out.withColumn("bytes_written", F.when(F.col("method") == "fallback_copied", F.col("size")).otherwise(F.lit(0)))


def capacity(planned: DataFrame, volumes: DataFrame, on: str = "path") -> DataFrame:
    """needed and available bytes of each volume; insufficient only where the capacity is known to be too small."""
    need = with_volume(copy_set(planned).select(on, "size"), on, volumes, "volume").groupBy("volume").agg(F.sum("size").alias("needed"))
    return need.join(volumes, "volume", "left").select("volume", "needed", "available", F.coalesce(F.col("available") < F.col("needed"), F.lit(False)).alias("insufficient"))


def copy_stats(outcomes: DataFrame, elapsed: float) -> DataFrame:
    """Counters of ``outcomes(action, method, size)`` and throughput in bytes a second, null for no time."""
    linked = F.col("action") == "linked"
    how = lambda m: F.count_if(linked & (F.col("method") == m)).alias(f"files_{m}")
    written = (F.col("action") == "copied") | (linked & (F.col("method") == "fallback_copied"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0))
    return outcomes.agg(
        F.count_if(F.col("action") == "copied").alias("files_copied"),
        *(how(m) for m in ("linked", "cloned", "symlinked", "fallback_copied")),
        F.count_if(F.col("action") == "skipped").alias("files_skipped"),
        F.count_if(F.col("action") == "error").alias("files_errored"),
        total(written).alias("bytes_written"),
        total(linked & (F.col("method") != "fallback_copied")).alias("bytes_saved"),
        F.try_divide(total(written), F.lit(float(elapsed))).alias("throughput"),
    )

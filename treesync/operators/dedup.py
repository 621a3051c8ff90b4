"""Identical content: by size, then by hash; one canonical file, the others duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesync.functions.paths import relative, to_dest
from treesync.functions.shared import staged
from treesync.operators.hot import join_classes
from treesync.operators.plan import index_within
from treesync.schemas import LAST

KEY = ["size", "hash_algo", "hash"]


def scan_order() -> Column:
    """The order that makes a file canonical: physical offset, unknown ones last, then path."""
    return F.struct(F.coalesce("physical_offset", F.lit(LAST)).alias("at"), F.col("path").alias("path"))


def size_collisions(files: DataFrame) -> DataFrame:
    """Files whose size occurs twice or more. Sizes are counted before the shuffle; the join is on counts, never on members."""
    sizes = files.groupBy("size").count().where("count > 1").select("size")
    return files.join(sizes, "size", "left_semi")


def hash_groups(files: DataFrame) -> DataFrame:
    """One row per content that two or more files have: its key, number of members and canonical path."""
    known = files.where("hash is not null")
    return known.groupBy(*KEY).agg(F.count("*").alias("members"), F.min(scan_order()).alias("first")).where("members > 1").select(*KEY, "members", F.col("first.path").alias("canonical_path"))


def plan(files: DataFrame, src_root: str, dst_root: str, dedup: bool = True) -> DataFrame:
    """FILES with rel_path, dest_path, role {unique, canonical, duplicate, unhashed}, group_id and canonical_path; every row once.

    Files of a size of their own are unique and lose their hash (they need none); files that could not be hashed are
    ``unhashed``. A file of unknown size is ``unhashed`` without a hash, and else unique. Each content has one canonical row, also
    where its path is listed twice. Without ``dedup`` all are unique.

    Rows are staged once (leave content out). Sizes and contents are counted before they shuffle; those with many rows are
    broadcast, so one empty file that makes up a third of the rows is no large task.
    """
    paths = {"rel_path": relative(F.col("path"), src_root), "dest_path": to_dest(F.col("path"), src_root, dst_root)}
    if not dedup:
        return files.withColumns(paths | {"role": F.lit("unique"), "group_id": F.lit(None).cast("string"), "canonical_path": F.lit(None).cast("string")})
    rows = staged(files.withColumn("__row", F.monotonically_increasing_id()), "plan-rows")
    sizes = staged(rows.where("size is not null").groupBy("size").agg(F.count("*").alias("same_size")), "sizes")
    first = F.min(F.struct(F.coalesce("physical_offset", F.lit(LAST)).alias("at"), "path", "__row"))
    contents = rows.where("hash is not null").groupBy(*KEY).agg(F.count("*").alias("weight"), first.alias("first")).where("weight > 1")
    contents = staged(contents.select(*KEY, "weight", F.col("first.path").alias("canonical_path"), F.col("first.__row").alias("__canonical")), "contents")
    # A file whose content has another is no longer in question, so sizes are looked up for the others only.
    known = staged(join_classes(rows, contents, KEY), "plan-contents")
    alone = known.where("__canonical is null")
    single = F.when(F.col("hash").isNull(), "unhashed").otherwise("unique")
    judged = join_classes(alone, sizes.withColumn("weight", F.col("same_size")), ["size"]).withColumn("role", F.when(F.col("same_size") == 1, "unique").otherwise(single))
    judged = judged.withColumn("hash", F.when(F.coalesce("same_size", F.lit(2)) > 1, F.col("hash"))).drop("same_size")
    grouped = known.where("__canonical is not null").withColumn("role", F.when(F.col("__row") == F.col("__canonical"), "canonical").otherwise("duplicate"))
    out = judged.unionByName(grouped).withColumn("group_id", F.when(F.col("canonical_path").isNotNull(), F.concat_ws(":", "hash_algo", "hash")))
    return out.select(*files.columns, "canonical_path", "role", "group_id").withColumns(paths)


def stats(planned: DataFrame) -> DataFrame:
    copies = F.col("role") == "duplicate"
    return planned.agg(
        F.count("*").alias("total_files"),
        (F.count("*") - F.count_if(copies)).alias("unique_files"),
        F.count_if(copies).alias("duplicate_files"),
        F.coalesce(F.sum(F.when(copies, F.col("size"))), F.lit(0)).alias("bytes_saved"),
    )


def group_chunks(planned: DataFrame, chunk_size: int = 50) -> DataFrame:
    """canonical, chunk, duplicates (ordered array of at most ``chunk_size``) of every group, however large."""
    members = planned.where("role = 'duplicate'").select(F.col("canonical_path").alias("canonical"), "path")
    chunk = F.floor(F.col("at") / chunk_size).alias("chunk")
    return index_within(members, "canonical", "path", "at").groupBy("canonical", chunk).agg(F.array_sort(F.collect_list("path")).alias("duplicates"))

"""Batches of files by bytes or by count, and archives of small files."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesync.functions.paths import relative
from treesync.operators import scans
from treesync.operators.plan import index_within


def greedy_batches(sizes: np.ndarray, batch_size: int) -> np.ndarray:
    return scans.greedy_run(sizes, batch_size)[0]


def by_bytes(files: DataFrame, batch_size: int = 100 << 20, shard: str = "shard", order: str = "path", sub_shards: int = 1) -> DataFrame:
    """``files`` with ``sub_shard`` and ``batch``, exact within each shard (a null shard is one too) and sub-shard, in the given order; every row stays once.

    A large shard is spread over range partitions, see ``scans.greedy_batches``. ``sub_shards`` splits shards by a hash of the
    order key. Ties are in order of size. Rows pass through whole: leave content out. Unknown sizes count as 0.
    """
    sub = F.pmod(F.xxhash64(order), F.lit(sub_shards)).cast("int")
    return scans.greedy_batches(files.drop("sub_shard", "batch").withColumn("sub_shard", sub), [shard, "sub_shard"], [order, "size"], batch_size)


def _keys(batched: DataFrame, shard: str) -> list[str]:
    """What names a batch: its shard, its sub-shard if it has one, and its number."""
    return [shard, *(["sub_shard"] if "sub_shard" in batched.columns else []), "batch"]


def by_count(files: DataFrame, root: str, n: int = 5000, shard: str = "shard", order: str = "path") -> DataFrame:
    """Chunks of n paths in each shard, large ones spread over range partitions; paths that aren't under the root are dropped first."""
    below = files.where(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("rel_path", relative(F.col("path"), root))
    return index_within(below, shard, order, "__at").withColumn("batch", F.floor(F.col("__at") / n)).drop("__at")


def totals(batched: DataFrame, shard: str = "shard", failed: str | None = None) -> DataFrame:
    """files and bytes of each batch (by sub-shard too, if there are any); batches with a failed file are left out."""
    grouped = batched.groupBy(*_keys(batched, shard)).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), *([F.max(failed).alias("failed")] if failed else []))
    return grouped.where(~F.col("failed")).drop("failed") if failed else grouped


def pack(batched: DataFrame, compress: bool = False, shard: str = "shard") -> DataFrame:
    """One tar archive (with fast gzip if asked for) per shard, sub-shard and batch of ``batched(shard, batch, rel_path, content)``; a batch must fit a row."""

    def archive(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for name, content in sorted(zip(rows["rel_path"], rows["content"], strict=True)):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
        data = gzip.compress(out.getvalue(), 1, mtime=0) if compress else out.getvalue()
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "sub_shard": rows["sub_shard"].iloc[:1], "batch": rows["batch"].iloc[:1], "archive": [data]})

    sub = F.col("sub_shard") if "sub_shard" in batched.columns else F.lit(0)
    slim = batched.select(F.col(shard).cast("string").alias("shard"), sub.alias("sub_shard"), "batch", "rel_path", F.col("content").cast("binary").alias("content"))
    return slim.groupBy("shard", "sub_shard", "batch").applyInPandas(archive, "shard string, sub_shard int, batch long, archive binary")


def unpack(archives: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["archive"]:
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
                    members = [(m.name, tar.extractfile(m).read()) for m in tar.getmembers()]
                yield pd.DataFrame(members, columns=["rel_path", "content"])

    return archives.select("archive").mapInPandas(run, "rel_path string, content binary")

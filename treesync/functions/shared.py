"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder becomes the checkpoint folder on a local master, and is an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/treesync/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read again: computed once, and no executor's loss repeats what came before."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def mounted(path: str) -> str:
    """A path of a mounted file system, without the scheme ``file:``; another scheme is an error."""
    plain = re.sub("^file:/+", "/", path)
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", plain):
        raise ValueError(f"not a mounted file system: {path}")
    return plain


def _hadoop(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a file system that Spark knows; one that isn't there is no error."""
    fs, folder = _hadoop(spark, path)
    fs.delete(folder, True)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the folders ``name=<number>`` below ``path``, in order; a folder that isn't there has none."""
    fs, folder = _hadoop(spark, path)
    if not fs.exists(folder):
        return []
    found = [re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in fs.listStatus(folder)]
    return sorted(int(m.group(1)) for m in found if m)


def committed(spark: SparkSession, path: str, name: str) -> list[int]:
    """Those of ``numbered`` whose writing ended."""
    fs, _ = _hadoop(spark, path)
    return [n for n in numbered(spark, path, name) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={n}/_SUCCESS"))]

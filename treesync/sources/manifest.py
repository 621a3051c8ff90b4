"""Manifests of earlier runs: load, save, resume, mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.schemas import MANIFEST, MANIFEST_DOC
from treesync.sources.commits import TURN, CommitLog


def load(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """MANIFEST rows of JSON documents, one a file, or one a line; an unreadable document gives none, a missing one is an error of the reader."""
    doc = spark.read.schema(MANIFEST_DOC).option("multiLine", not lines).json(path)
    rows = doc.select(F.explode(F.map_entries("files")).alias("e"))
    return rows.select(F.col("e.key").alias("rel_path"), "e.value.size", "e.value.source_hash", "e.value.status", "e.value.updated_at")


#: A checkpoint merges the commits of a manifest once there are so many since the last one.
CHECKPOINT_EVERY = 20


def _log(spark: SparkSession, path: str) -> CommitLog:
    return CommitLog(spark, path, MANIFEST)


def _last_wins(rows: DataFrame) -> DataFrame:
    """The row of the last commit for each path; of several in one commit, one that the newest time, then the greatest values decide."""
    order = F.struct(TURN, "updated_at", "size", "source_hash", "status")
    last = rows.groupBy("rel_path").agg(F.max_by(F.struct("size", "source_hash", "status", "updated_at"), order).alias("last"))
    return last.select("rel_path", "last.*")


def save(manifest: DataFrame, path: str) -> int:
    """Replace the whole manifest by one commit and return its number; a reader sees the old one or the new one."""
    rows = manifest.withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp()))
    return _log(manifest.sparkSession, path).append(rows, whole=True)


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as all commits make it, or no rows where there is none."""
    return _last_wins(_log(spark, path).rows())


def record(rows: DataFrame, path: str, meta: dict | None = None, every: int = CHECKPOINT_EVERY) -> int:
    """Commit ``rows(rel_path, size, source_hash, status)``, which replace those of the same path; the number of the commit.

    Writes those rows only. Every ``every`` commits a checkpoint merges what there is. Writers at once each get a number of
    their own, and what a writer committed stays, whatever becomes of it afterwards.
    """
    log = _log(rows.sparkSession, path)
    number = log.append(rows.select("rel_path", "size", "source_hash", "status", F.current_timestamp().alias("updated_at")), meta)
    if (number + 1) % every == 0:
        log.checkpoint(_last_wins)
    return number


def history(spark: SparkSession, path: str) -> list[dict]:
    """What the commits since the last checkpoint say of themselves, in order."""
    return [{"number": c.number, **c.meta} for c in _log(spark, path).commits()]


def remove(spark: SparkSession, path: str) -> None:
    """Drop a manifest with all its commits; one that isn't there is no error."""
    _log(spark, path).remove()


def export_json(manifest: DataFrame) -> DataFrame:
    """One JSON map of a small manifest, for other tools; big manifests stay tables."""
    value = F.struct(F.col("rel_path").alias("relative_path"), "size", "source_hash", "status")
    return manifest.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("rel_path"), value.alias("value")))))).alias("files"))


def documents(rows: DataFrame, shard: str, entries: int = 10_000) -> DataFrame:
    """version, files: JSON documents of ``rows(rel_path, size, source_hash, status)`` by shard, of about ``entries`` entries at most each; their number grows with the rows."""
    salt = F.pmod(F.xxhash64("rel_path"), F.lit(max(1, -(-rows.count() // entries))))
    entry = F.struct(F.col("rel_path").alias("key"), F.struct(F.col("rel_path").alias("relative_path"), "size", "source_hash", "status").alias("value"))
    return rows.groupBy(shard, salt.alias("salt")).agg(F.map_from_entries(F.collect_list(entry)).alias("files")).select(F.lit(1).alias("version"), "files")


def pending(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned rows still to do: not in the manifest with equal size and, where both are known, equal hash. Its status doesn't matter."""
    done = manifest.select(F.col("rel_path").alias("__rel"), F.col("size").alias("__size"), "source_hash")
    same = (F.col("rel_path") == F.col("__rel")) & (F.col("size") == F.col("__size")) & (F.col("source_hash").isNull() | F.col("hash").isNull() | (F.col("source_hash") == F.col("hash")))
    return planned.join(done, same, "left_anti")


def progress(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("files"))


def mark_verified(manifest: DataFrame, checks: DataFrame) -> DataFrame:
    """Rows that were verified get that status and a new time; paths that aren't in the manifest are ignored."""
    good = checks.where("status = 'ok'").select("rel_path", F.lit(True).alias("__ok")).dropDuplicates(["rel_path"])
    out = manifest.join(good, "rel_path", "left").withColumn("status", F.when(F.col("__ok"), "verified").otherwise(F.col("status")))
    if "updated_at" in manifest.columns:
        out = out.withColumn("updated_at", F.when(F.col("__ok"), F.current_timestamp()).otherwise(F.col("updated_at")))
    return out.drop("__ok")

"""Run logs as JSON lines, their summary and running progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.operators import scans
from treesync.schemas import RUN_LOG


def write(log: DataFrame, path: str) -> None:
    """JSON lines; fields that are null are left out."""
    log.write.json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).json(path)


#: The names of ``counters``.
COUNTERS = ["files_copied", "files_linked", "files_skipped", "files_errored", "bytes_written"]


def counters() -> list[Column]:
    """Rows of each action, and bytes of copies only."""
    of = lambda a: F.count_if(F.col("action") == a)
    return [
        of("copied").alias("files_copied"),
        of("linked").alias("files_linked"),
        of("skipped").alias("files_skipped"),
        of("error").alias("files_errored"),
        F.coalesce(F.sum(F.when(F.col("action") == "copied", F.col("size"))), F.lit(0)).alias("bytes_written"),
    ]


def summary(log: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    return log.groupBy(*by).agg(*counters())


def timed(log: DataFrame) -> DataFrame:
    """``log`` with its time as ``at``, null where it can't be read."""
    return log.withColumn("at", F.try_to_timestamp("timestamp"))


def windows(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, run and counters of each tumbling window of the lines' own times.

    A line that was written again, with the same run and seq, counts once. A line without a readable time is in no window, as
    ``timed`` shows.
    """
    return by_window(timed(log).where("at is not null").dropDuplicates(["run", "seq"]), width)


def by_window(lines: DataFrame, width: str) -> DataFrame:
    """The counters of ``lines(at, run, ...)``, each taken as it is."""
    return lines.groupBy(F.window("at", width).alias("window"), "run").agg(*counters()).select(F.col("window.start").alias("start"), "run", *COUNTERS)


def progress(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """files_done and bytes_done so far, and their totals, within each of ``by``; a long run is spread over range partitions."""
    rows = log.withColumn("__one", F.lit(1).cast("long"))
    return scans.running_sums(rows, by, order, {"files_done": "__one", "bytes_done": "size"}, {"files_total": "files_done", "bytes_total": "bytes_done"}).drop("__one")

"""Run logs, the hash cache and arriving files as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from treesync.functions.shared import committed, numbered, remove_folder
from treesync.operators.hot import join_classes
from treesync.schemas import LAST
from treesync.sources import cache, runlog


def log_summary(stream: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """The summary of runs in progress; for output modes complete and update."""
    return stream.groupBy(*by).agg(*runlog.counters())


def progress(stream: DataFrame) -> DataFrame:
    """Latest counters of each run and phase; counters only grow, so the maximum is the latest."""
    return stream.groupBy("run", "phase").agg(F.max("progress.files_done").alias("files_done"), F.max("progress.bytes_done").alias("bytes_done"))


#: What ``log_windows`` writes: the counters of a window as they were after a batch.
WINDOWS = "key struct<start: timestamp, run: bigint>, " + "".join(f"{c} long, " for c in runlog.COUNTERS) + "batch long"


def log_windows(stream: DataFrame, table: str, checkpoint: str, width: str = "1 hour", late: str = "1 day", every: int = 20) -> StreamingQuery:
    """The counters of each run in tumbling windows of its lines' own times, as ``runlog.windows`` has them, while lines arrive in any order.

    Lines may be ``late`` behind the newest one and come again within that time: each counts once. What arrives later than that is not
    counted, as its window's state is gone; ``late_lines`` says how many those were, and ``runlog.windows`` over the files of the log
    has them all. So state is bounded by the lines of that time. A batch writes the windows it changed, open ones too;
    ``window_state`` gives the newest of each. Batches that run again overwrite what they wrote.
    """
    lines = runlog.timed(stream).where("at is not null").withWatermark("at", late).dropDuplicatesWithinWatermark(["run", "seq"])

    def put(rows: DataFrame, batch: int) -> None:
        changed = rows.select(F.struct("start", "run").alias("key"), *runlog.COUNTERS, F.lit(batch).cast("long").alias("batch"))
        _merge(rows.sparkSession, table, batch, every, changed.schema, lambda parts: _newest_rows(parts, "key", ("batch",)).select(*changed.columns))
        changed.write.mode("overwrite").parquet(f"{table}/batch={batch}")

    windows = runlog.by_window(lines, width)
    start = lambda: windows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return _start_on_rocksdb(stream.sparkSession, start)


def window_state(spark: SparkSession, table: str) -> DataFrame:
    """start, run and counters of all windows after the last batch whose writing ended."""
    newest = _newest_rows(_rows(spark, _parts(spark, table), StructType.fromDDL(WINDOWS)), "key", ("batch",))
    return newest.select("key.start", "key.run", *runlog.COUNTERS)


def late_lines(query: StreamingQuery) -> int:
    """How many lines were too late to count, over the progress that the query still has."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


#: Keeps a stream's state on disk, a look-up a key, with a log of changes as its checkpoint.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _start_on_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with its state in RocksDB: a query takes the settings that hold as it starts."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        return start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _parts(spark: SparkSession, table: str) -> list[tuple[int, int, str]]:
    """(first batch, end, folder) of the whole parts of a table, the largest at each place, in order: batches, and merged ones that replace them."""
    have = [(n, n + 1, f"{table}/batch={n}") for n in committed(spark, table, "batch")]
    for level in numbered(spark, table, "of"):
        have += [(n * level, (n + 1) * level, f"{table}/of={level}/part={n}") for n in committed(spark, f"{table}/of={level}", "part")]
    out, at = [], 0
    for first, end, folder in sorted(have, key=lambda p: (p[0], -p[1])):
        if first >= at:
            out.append((first, end, folder))
            at = end
    return out


def _rows(spark: SparkSession, parts: list[tuple[int, int, str]], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*(p for *_, p in parts)) if parts else spark.createDataFrame([], schema)


def _merge(spark: SparkSession, table: str, batch: int, every: int, schema: StructType, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Before batch ``batch`` is written: where it ends a run of ``every`` batches, merge those into one part; where that ends a run of ``every`` parts, merge these too, and so on.

    So a row is rewritten once a level, and there are as many levels as the logarithm of the number of batches. What was merged is
    removed once its part is whole and the next batch has begun. A batch that runs again does the same.
    """
    size = every
    while batch and batch % size == 0:
        first = batch - size
        below = [p for p in _parts(spark, table) if first <= p[0] and p[1] <= batch]
        done = f"{table}/of={size}/part={first // size}"
        if [p[2] for p in below] != [done]:
            merge(_rows(spark, below, schema)).write.mode("overwrite").parquet(done)
            for *_, folder in below:
                remove_folder(spark, folder)
        size *= every


def _newest_rows(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    return cache.upsert(rows.limit(0), rows, key, list(order))


def cache_upsert(stream: DataFrame, table: str, checkpoint: str, key: str = "path", order: tuple[str, ...] = ("seq",), every: int = 20) -> StreamingQuery:
    """Each micro-batch adds its newest row per key to ``table``; ``cache_state`` gives the newest of all.

    A batch writes its own rows only. ``every`` batches are merged into one part, ``every`` parts into a larger one, and so on, so a
    row is written once a level. Batches that run again overwrite what they wrote.
    """

    def put(rows: DataFrame, batch: int) -> None:
        _merge(rows.sparkSession, table, batch, every, rows.schema, lambda all_rows: _newest_rows(all_rows, key, order).select(*rows.columns))
        _newest_rows(rows, key, order).select(*rows.columns).write.mode("overwrite").parquet(f"{table}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_state(spark: SparkSession, table: str, schema: StructType, key: str = "path", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The row of the last order for each key, over all batches whose writing ended."""
    return _newest_rows(_rows(spark, _parts(spark, table), schema), key, order)


KEY = ["size", "hash_algo", "hash"]


def _first_seen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The canonical path of a content: the one in the state, else the least in scan order of what arrives now, which goes there."""
    if state.exists:
        (path,), new = state.get, False
        for _ in frames:
            pass
    else:
        least = None
        for frame in frames:
            for at, mine in zip(frame["at"], frame["mine"], strict=True):
                least = (at, mine) if least is None or (at, mine) < least else least
        path, new = least[1], True
        state.update((path,))
    yield pd.DataFrame({"size": [key[0]], "hash_algo": [key[1]], "hash": [key[2]], "canonical_path": [path], "new": [new]})


def _local_firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the contents of an Arrow batch, the first file of each, so that many copies are few rows before they meet."""
    for rows in batches:
        yield rows.sort_values(["at", "mine"]).drop_duplicates(KEY)


def dedup(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Arriving files against all earlier content: the first file seen of a content stays canonical for ever.

    The canonical path of every content is keyed state in RocksDB: a batch looks up the contents that arrive in it and no others, so
    its work grows with it and not with all that was seen. ``files/batch=n`` has each file with its role and canonical path,
    ``canonicals/batch=n`` the contents that were new. A path that arrives again with the content whose canonical it is is
    canonical again, once in a batch; other repeats are duplicates. Files of unknown size or hash are ``unhashed``. Batches that run again,
    from the state before them, overwrite what they wrote.
    """
    files = stream.schema
    known = stream.where("hash is not null and size is not null and hash_algo is not null")
    firsts = known.select(*KEY, F.coalesce("physical_offset", F.lit(LAST)).alias("at"), F.col("path").alias("mine"))
    firsts = firsts.mapInPandas(_local_firsts, firsts.schema)
    found = firsts.groupBy(*KEY).applyInPandasWithState(_first_seen, "size long, hash_algo string, hash string, canonical_path string, new boolean", "canonical_path string", "append", "NoTimeout")
    arrived = stream.select(F.struct(*files.fieldNames()).alias("file"))
    both = found.select(F.lit(None).cast(arrived.schema["file"].dataType).alias("file"), F.struct(*found.columns).alias("found")).unionByName(arrived.withColumn("found", F.lit(None).cast(found.schema)))

    def put(rows: DataFrame, batch: int) -> None:
        spark, part = rows.sparkSession, f"{table}/arrived/batch={batch}"
        rows.write.mode("overwrite").parquet(part)
        rows = spark.read.schema(rows.schema).parquet(part)
        contents = rows.where("found is not null").select("found.*")
        contents.where("new").drop("new").write.mode("overwrite").parquet(f"{table}/canonicals/batch={batch}")
        mine = rows.where("found is null").select("file.*").withColumn("__row", F.monotonically_increasing_id())
        counted = mine.where("hash is not null").groupBy(*KEY).agg(F.count("*").alias("weight")).join(contents.drop("new"), KEY)
        again = mine.groupBy("path", *KEY).agg(F.min("__row").alias("__row")).withColumn("__first", F.lit(True))
        joined = join_classes(mine.join(again, ["path", *KEY, "__row"], "left"), counted, KEY)
        roles = F.when(F.col("canonical_path").isNull(), "unhashed").when((F.col("canonical_path") == F.col("path")) & F.col("__first"), "canonical").otherwise("duplicate")
        joined.withColumn("role", roles).select(*files.fieldNames(), "canonical_path", "role").write.mode("overwrite").parquet(f"{table}/files/batch={batch}")
        remove_folder(spark, part)

    return _start_on_rocksdb(stream.sparkSession, lambda: both.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

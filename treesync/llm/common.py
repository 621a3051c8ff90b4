"""What the training-data operators share: staged tables, row addresses, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to Python; documents can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 500


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, on a local master only."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir") or spark.conf.get("treesync.test.shared", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("treesync.test.shared", root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str, codec: str = "snappy", batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; ``batch_rows`` holds for this write's Arrow batches.

    Cuts the lineage: a lost executor costs no recomputation of what lies before, and values that depend on how
    rows are dealt out (row addresses) are fixed from here on. The reader sees the schema of ``df``, even when empty.
    """
    path = f"{shared_root(df.sparkSession)}/treesync/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = df.sparkSession.conf.get(key)
    df.sparkSession.conf.set(key, str(batch_rows or before))
    try:
        df.write.option("compression", codec).option("parquet.block.size", 16 << 20).parquet(path)
    finally:
        df.sparkSession.conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, unless the session already sets less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_address(df: DataFrame, block: str = "block", pos: str = "pos") -> DataFrame:
    """Add the partition number and the position in it. Stage the result before using it twice."""
    address = F.monotonically_increasing_id()
    return df.withColumn("__address", address).withColumns({block: F.shiftright("__address", 33).cast("int"), pos: F.col("__address").bitwiseAND((1 << 33) - 1)}).drop("__address")


def sum_vectors(parts: DataFrame) -> DataFrame:
    """Sum ``parts(key int, vec binary)``, vectors of 64-bit integers, by key. Streams: memory is one vector a key in a task, however many parts there are."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, vec in zip(batch["key"], batch["vec"], strict=True):
                new = np.frombuffer(vec, np.int64)
                sums[key] = sums[key] + new if key in sums else new
        yield pd.DataFrame({"key": list(sums), "vec": [v.tobytes() for v in sums.values()]}).astype({"key": "int32"})

    return parts.select("key", "vec").repartition("key").mapInPandas(add, "key int, vec binary")


def bounded(df: DataFrame, rows: int = 400_000) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``rows`` rows (it should be narrow and staged), else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], how: str = "left", most: int = 500) -> DataFrame:
    """``rows`` joined with ``classes(*keys, weight, ...)``, weight being the number of rows of a class; drops weight.

    Classes of more than ``most`` rows, or of more than 1 in 50,000 of all rows, are broadcast: there are at most 50,000
    of them whatever the input. So no task gets a hot class. Keys are not null, or have no class.
    """
    total = classes.agg(F.sum("weight")).first()[0] or 0
    hot = F.col("weight") > max(most, total // 50_000)
    heavy = F.broadcast(classes.where(hot).drop("weight"))
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(classes.where(~hot).drop("weight"), keys, how)
    return rows.join(heavy, keys).unionByName(light)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(id, component_id)`` per node, the smallest id reachable.

    Rounds of hooking every node onto its smallest neighbour, following the pointers to their roots by doubling, and
    contracting the edges to roots. Each round at least halves the nodes that still have edges. Counts and minima
    combine before they shuffle, joins are on one pointer row per node, so a node with very many edges is no hot group.
    Nothing but row counts reaches the driver. Empty input gives an empty result. Edges left after ``max_rounds`` are an error.
    """
    spark = edges.sparkSession
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointer = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "pointers")
        while True:
            ahead = pointer.select(F.col("id").alias("to"), F.col("to").alias("ahead"))
            pointer, moved = stage(pointer.join(ahead, "to").select("id", F.col("ahead").alias("to"), (F.col("ahead") != F.col("to")).alias("moved")), "pointers"), None
            moved = pointer.where("moved").isEmpty()
            pointer = pointer.select("id", "to")
            if moved:
                break
        maps.append(pointer)
        live = stage(
            live.join(pointer.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a")
            .join(pointer.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    if not live.isEmpty():
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "id long, component_id long")
    out = maps[0]
    for later in maps[1:]:
        out = out.join(later.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    return stage(out.select("id", F.col("to").alias("component_id")), "components")

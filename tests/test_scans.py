"""Running sums, positions and greedy batches over range partitions, against plain folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treesync.operators import batches, dedup, plan, scans
from treesync.sources import runlog


def fold(sizes, limit):
    out, run, batch = [], 0, 0
    for s in sizes:
        out.append(batch)
        run += s or 0
        if run >= limit:
            run, batch = 0, batch + 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_passages_are_plain_folds(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 7, 20, 1000])
    sizes = [rng.choice([0, 0, 1, 3, 9, 25]) if seed % 3 else 5 for _ in range(rng.choice([1, 2, 30, 200]))]
    table = scans.passage(np.array(sizes), limit)
    for run in range(min(limit, 60)):
        closed, size = 0, run
        for s in sizes:
            size += s
            if size >= limit:
                closed, size = closed + 1, 0
        assert scans.passed(run, sum(sizes), limit, *table) == (closed, size)
        assert scans.passed(run, sum(sizes), limit, *scans._unpacked(scans._packed(*table))) == (closed, size)


def cases(rng, hot):
    group = (lambda: rng.choice(["a", "a", "a", "a", "b", None])) if hot else (lambda: rng.choice([*map(str, range(40)), None]))
    return [(f"p{i:05}", rng.choice([0, 3, 9, 25, None]), group(), i % 7) for i in range(1500)]


@pytest.mark.parametrize("hot", [True, False])
def test_one_hot_group_over_many_partitions(spark, hot):
    rows = cases(random.Random(2), hot)
    df = spark.createDataFrame(rows, "path string, size long, shard string, run int")
    by = {}
    for r in sorted(rows):
        by.setdefault(r[2], []).append(r)
    found = scans.greedy_batches(df.repartition(5), ["shard"], ["path"], 40, partitions=23).withColumn("task", F.spark_partition_id()).collect()
    got = {r["path"]: r["batch"] for r in found}
    for members in by.values():
        assert [got[r[0]] for r in members] == fold([r[1] for r in members], 40)
    assert len(found) == len(rows) and len({r["task"] for r in found if not hot or r["shard"] == "a"}) > 10
    assert [r["batch"] for r in sorted(scans.greedy_batches(df, [], ["path"], 100, partitions=7).collect())] == fold([r[1] for r in sorted(rows)], 100)
    summed = {r["path"]: r for r in scans.running_sums(df, ["shard"], ["path"], {"done": "size"}, {"whole": "done"}, partitions=17).collect()}
    for members in by.values():
        done = np.cumsum([r[1] or 0 for r in members]).tolist()
        assert [(summed[r[0]]["done"], summed[r[0]]["whole"]) for r in members] == [(d, done[-1]) for d in done]
    at = {r["path"]: r["i"] for r in scans.position(df, ["shard"], [F.col("path")], "i", partitions=9).collect()}
    assert all([at[r[0]] for r in members] == list(range(len(members))) for members in by.values())


def test_equal_keys_are_spread(spark):
    df = spark.createDataFrame([("same", 2, "s")] * 900, "path string, size long, shard string")
    out = scans.greedy_batches(df.repartition(3), ["shard"], ["path"], 10, partitions=11).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["batch"] for r in out) == sorted(fold([2] * 900, 10)) and len({r["task"] for r in out}) > 5
    assert sorted(r["i"] for r in scans.position(df, [], ["path"], "i", partitions=5).collect()) == list(range(900))


def test_nothing_and_limits(spark):
    none = spark.createDataFrame([], "path string, size long, shard string")
    assert scans.greedy_batches(none, ["shard"], ["path"], 10).count() == 0 and scans.running_sums(none, ["shard"], ["path"], {"x": "size"}, {"t": "x"}).count() == 0
    with pytest.raises(ValueError):
        scans.greedy_batches(none, [], ["path"], 0)


def exchanges(df):
    text = df._jdf.queryExecution().toString()
    physical = text[text.index("== Physical Plan ==") :]
    return [line for line in physical.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "ReusedExchange" not in line]


def test_rows_are_shuffled_once(spark):
    """After the range exchange, which the checkpoint ends, only rows of one a partition and group are exchanged."""
    df = spark.createDataFrame([(f"p{i}", i, "s", i) for i in range(100)], "path string, size long, shard string, physical_offset long")
    log = df.selectExpr("shard AS run", "physical_offset AS seq", "size")
    for out in (plan.with_index(df), batches.by_count(df.withColumn("path", F.concat(F.lit("/r/"), "path")), "/r", 7), runlog.progress(log, ["run"], ["seq"]), batches.by_bytes(df, 50)):
        assert all("path" not in e and "seq" not in e for e in exchanges(out)), exchanges(out)


def test_group_chunks_of_a_hot_group(spark):
    df = spark.createDataFrame([(f"/s/{i:04}", "duplicate", "/s/c") for i in range(500)] + [("/s/x", "duplicate", "/s/d")], "path string, role string, canonical_path string")
    chunks = {(r["canonical"], r["chunk"]): r["duplicates"] for r in dedup.group_chunks(df, 120).collect()}
    assert [len(chunks["/s/c", i]) for i in range(5)] == [120] * 4 + [20] and chunks["/s/d", 0] == ["/s/x"]
    assert chunks["/s/c", 1] == [f"/s/{i:04}" for i in range(120, 240)]

"""Batches with sub-shards and null shards, presence flags, and streams of many micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from treesync.operators import batches, delta, verify
from treesync.sources import runlog
from treesync.streaming import streams


def fold(sizes, limit):
    out, run, batch = [], 0, 0
    for s in sizes:
        out.append(batch)
        run += s
        if run >= limit:
            run, batch = 0, batch + 1
    return out


@pytest.mark.parametrize("sub_shards", [1, 3])
def test_batches_are_a_plain_fold(spark, sub_shards):
    rng = random.Random(1)
    rows = [(f"p{i:04}", rng.choice([0, 3, 9, 25]), rng.choice(["a", "b", None])) for i in range(600)] + [("p0001", 5, "a")]
    df = spark.createDataFrame(rows, "path string, size long, shard string")
    out = batches.by_bytes(df, 20, sub_shards=sub_shards).collect()
    assert len(out) == len(rows)
    groups = {}
    for r in sorted(out, key=lambda r: (r["path"], r["batch"])):
        groups.setdefault((r["shard"], r["sub_shard"]), []).append(r)
    assert {s for s, _ in groups} == {"a", "b", None}
    totals = {(r["shard"], r["sub_shard"], r["batch"]): r["bytes"] for r in batches.totals(batches.by_bytes(df, 20, sub_shards=sub_shards)).collect()}
    for (shard, sub), members in groups.items():
        if shard != "a":  # "a" has a tie, whose order is open
            assert [r["batch"] for r in members] == fold([r["size"] for r in members], 20)
        last = max(b for s, u, b in totals if (s, u) == (shard, sub))
        assert all(20 <= n < 45 for (s, u, b), n in totals.items() if (s, u) == (shard, sub) and b < last)


def test_unknown_sizes_are_present(spark):
    schema = "path string, size long, modified_epoch long"
    src, dst = spark.createDataFrame([("/s/a", None, 1), ("/s/b", 2, 1)], schema), spark.createDataFrame([("/d/a", 1, 1), ("/d/b", None, 1), ("/d/c", None, 1)], schema)
    assert {r["rel_path"]: r["status"] for r in delta.mirror(src, dst, "/s", "/d").collect()} == {"a": "changed", "b": "changed", "c": "orphan"}
    planned = spark.createDataFrame([("a", "/d/a", 1, "h", "unique")], "rel_path string, dest_path string, size long, hash string, role string")
    there = spark.createDataFrame([("/d/a", None, "h")], "path string, size long, hash string")
    assert verify.check(planned, there).first()["status"] == "size_mismatch"


def arrivals(spark, folder, rows, batches):
    for i in range(batches):
        rows.where(F.col("n") % batches == i).drop("n").coalesce(1).write.mode("append").parquet(str(folder))
    return lambda: spark.readStream.schema(rows.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_many_micro_batches(spark, tmp_path):
    rows = [(f"/s/{i:03}", i % 7, "sha256", f"h{i % 7}", None, i // 2) for i in range(100)] + [("/s/null", None, None, None, None, 3), ("/s/000", 0, "sha256", "h0", None, 8), ("/s/000", 0, "sha256", "h0", None, 8), ("/s/a", 5, "sha256", "h0", None, 9)]
    df = spark.createDataFrame(rows, "path string, size long, hash_algo string, hash string, physical_offset long, n int")
    stream = arrivals(spark, tmp_path / "in", df, 50)
    query = streams.dedup(stream(), str(tmp_path / "table"), str(tmp_path / "state"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "table" / "files"))
    assert out.count() == 104 and spark.read.parquet(str(tmp_path / "table" / "canonicals")).count() == 8
    by = {}
    for r in out.collect():
        by.setdefault((r["batch"], r["path"]), []).append((r["role"], r["canonical_path"]))
    firsts = {f"h{k}": f"/s/{k:03}" for k in range(7)}
    assert all(by[i // 2, p][0] == ("canonical" if i < 7 else "duplicate", firsts[h]) for i, (p, _, _, h, _, _) in enumerate(rows[:100]))
    assert by[3, "/s/null"] == [("unhashed", None)] and sorted(by[8, "/s/000"]) == [("canonical", "/s/000"), ("duplicate", "/s/000")] and by[9, "/s/a"] == [("canonical", "/s/a")]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    read = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators and p.numInputRows]
    assert len(read) == 50 and max(read[10:]) <= 1 and query.recentProgress[-1].stateOperators[0].numRowsTotal == 8  # what a batch touches, and all that is kept


def test_a_batch_that_runs_again(spark, tmp_path):
    rows = [(f"/s/{i:03}", 1, "sha256", f"h{i % 5}", None, i // 10) for i in range(40)]
    df = spark.createDataFrame(rows, "path string, size long, hash_algo string, hash string, physical_offset long, n int")
    stream = arrivals(spark, tmp_path / "in", df, 4)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    streams.dedup(stream(), table, state).awaitTermination()
    want = sorted(map(str, spark.read.parquet(f"{table}/files").collect()))
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").glob("[0-9]*"))
    for name in (str(last), f".{last}.crc"):  # died after its output, before its commit
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    streams.dedup(stream(), table, state).awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"{table}/files").collect())) == want


def test_merged_parts(spark, tmp_path):
    rows = [(f"/s/{i % 9}", i, i, i) for i in range(45)]
    df = spark.createDataFrame(rows, "path string, size long, seq int, n int")
    stream = arrivals(spark, tmp_path / "in", df, 45)
    streams.cache_upsert(stream(), str(tmp_path / "cache"), str(tmp_path / "state"), every=4).awaitTermination()
    state = streams.cache_state(spark, str(tmp_path / "cache"), df.drop("n").schema)
    assert {r["path"]: r["seq"] for r in state.collect()} == {f"/s/{i % 9}": i for i in range(36, 45)}
    have = sorted(str(p.relative_to(tmp_path / "cache")) for p in (tmp_path / "cache").rglob("_SUCCESS"))
    assert have == sorted(f"{p}/_SUCCESS" for p in ("batch=44", "of=16/part=0", "of=16/part=1", "of=4/part=10", "of=4/part=8", "of=4/part=9"))  # 0-15, 16-31, 32-43, 44


def log_lines(spark, rows):
    stamp = F.date_format(F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df = spark.createDataFrame(rows, "run long, seq long, minute long, action string, size long, n int")
    return df.withColumn("timestamp", F.when(F.col("minute").isNull(), "no time").otherwise(stamp)).drop("minute")


def test_log_in_windows(spark, tmp_path):
    """Lines out of order and repeated within the delay equal the batch; ones beyond it are counted as late."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        minute, action = i * 2, rng.choice(["copied", "linked", "skipped", "error"])
        row = (i % 3, i, minute, action, rng.choice([None, i]))
        arrives = i // 20
        rows.append((*row, min(arrives + rng.choice([0, 0, 0, 1, 2]), 29)))  # up to two batches, 80 minutes, late
        if i % 4 == 0:
            rows.append((*row, min(arrives + 2, 29)))
    log = log_lines(spark, [*rows, (0, 9000, None, "copied", 1, 3), (1, 9001, 1, "copied", 7, 29), (1, 9002, 1, "copied", 7, 29)])
    stream = arrivals(spark, tmp_path / "in", log, 30)
    query = streams.log_windows(stream(), str(tmp_path / "table"), str(tmp_path / "state"), late="4 hours", every=4)
    query.awaitTermination()
    got = {tuple(r) for r in streams.window_state(spark, str(tmp_path / "table")).collect()}
    in_time = runlog.windows(log.where("seq not in (9001, 9002)"))
    assert got == {tuple(r) for r in in_time.collect()} and len(got) > 50
    assert streams.late_lines(query) == 2
    assert {tuple(r) for r in runlog.windows(log).collect()} - got  # the batch has the late ones too
    kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(kept) < 400  # lines of some hours, not of all the time


def test_windows_of_a_batch_that_runs_again(spark, tmp_path):
    log = log_lines(spark, [(i % 2, i, i, "copied", i, i // 10) for i in range(40)])
    stream = arrivals(spark, tmp_path / "in", log, 4)
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    streams.log_windows(stream(), table, state).awaitTermination()
    want = {tuple(r) for r in runlog.windows(log).collect()}
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").glob("[0-9]*"))
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    streams.log_windows(stream(), table, state).awaitTermination()
    assert {tuple(r) for r in streams.window_state(spark, table).collect()} == want

"""A third of the rows under one key: plans, lookups and restores."""

from pyspark.sql import functions as F

from treesync.operators import dedup, hot
from treesync.sources import cache, store

FILES = "path string, size long, hash_algo string, hash string, physical_offset long"


def skew(df) -> float:
    """The largest partition with rows against the mean of all."""
    n = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(n) / (sum(n) / len(n))


def test_one_empty_file_is_a_third(spark):
    rows = [(f"/s/e{i:04}", 0, "sha256", "empty", None) for i in range(3000)] + [(f"/s/u{i:04}", i % 700 + 1, "sha256", f"h{i // 2 if i % 3 else i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, FILES).repartition(6)
    old = hot.LIGHT
    hot.join_classes.__defaults__ = ("weight", hot.SHARES, 50)
    try:
        found = dedup.plan(df, "/s", "/d")
        assert found.count() == 9000 and skew(found) < 3
    finally:
        hot.join_classes.__defaults__ = ("weight", hot.SHARES, old)
    plain = {r["path"]: r["role"] for r in dedup.plan(df, "/s", "/d").collect()}
    assert plain == {r["path"]: r["role"] for r in found.collect()}
    members = {}
    for path, size, algo, digest, at in rows:
        members.setdefault((size, algo, digest), []).append((at is None, at or 0, path))
    for group in members.values():
        ordered = [p for *_, p in sorted(group)]
        assert [plain[p] for p in ordered] == (["unique"] if len(ordered) == 1 else ["canonical"] + ["duplicate"] * (len(ordered) - 1))


def test_repeated_paths_and_unknown_sizes(spark):
    rows = [("/s/a", 3, "sha256", "x", None)] * 2 + [("/s/b", 3, "sha256", "x", None), ("/s/n", None, None, None, None), ("/s/m", None, "sha256", "x", None), ("/s/u", 3, None, None, None), ("/s/one", 9, "sha256", "y", None)]
    found = dedup.plan(spark.createDataFrame(rows, FILES), "/s", "/d")
    assert sorted(str((r["path"], r["role"], r["hash"])) for r in found.collect()) == sorted(map(str, [("/s/a", "canonical", "x"), ("/s/a", "duplicate", "x"), ("/s/b", "duplicate", "x"), ("/s/n", "unhashed", None), ("/s/m", "unique", "x"), ("/s/u", "unhashed", None), ("/s/one", "unique", None)]))
    assert dedup.stats(found).first()["duplicate_files"] == 2
    assert dedup.plan(spark.createDataFrame([], FILES), "/s", "/d").count() == 0


def test_a_file_with_many_links(spark):
    blobs = spark.createDataFrame([("hot", 3, b"abc"), ("cold", 1, b"x")], "ref string, size long, content binary")
    links = spark.range(5000).selectExpr("concat('/d/', id) AS dest_path", "'hot' AS ref").unionByName(spark.createDataFrame([("/d/cold", "cold")], "dest_path string, ref string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        out = store.joined(blobs, links, each=100, chunk=10)
        n = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(n) == 5001 and len(n) >= 10 and max(n) < 1200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["dest_path"], bytes(r["content"])) for r in out.collect()} == {(f"/d/{i}", b"abc") for i in range(5000)} | {("/d/cold", b"x")}


def test_lookups_leave_the_cache_where_it_is(spark):
    rows = [(f"/s/{i}", i, i, f"h{i}", "sha256", 1) for i in range(200)]
    schema = "path string, size long, mtime long, hash string, algo string, seq int"
    cache.write(spark.createDataFrame(rows, schema), "cache_test", 4)
    name = cache.renew(spark, "cache_test", spark.createDataFrame([("/s/3", 3, 9, "new", "sha256", 2), ("/s/4", 4, 4, "stale", "sha256", 0), ("/s/x", 1, 1, "hx", "sha256", 2)], schema), ["seq"], 4)
    assert spark.table(name).count() == 201
    files = spark.createDataFrame([("/s/3", 3, 9), ("/s/4", 4, 4), ("/s/5", 5, 6), ("/s/6", None, 6), ("/s/gone", 1, 1), ("/s/x", 1, 1), (None, 1, 1)], "path string, size long, modified_epoch long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = cache.lookup(files, spark.table(name))
        assert {r["path"]: r["cached_hash"] for r in out.collect()} == {"/s/3": "new", "/s/4": "h4", "/s/5": None, "/s/6": None, "/s/gone": None, "/s/x": "hx", None: None}
        text = out._jdf.queryExecution().toString()
        physical = text[text.index("== Physical Plan ==") :].split("Initial Plan")[0]
        scan = physical[: physical.index("FileScan")].splitlines()
        assert physical.count("Exchange hashpartitioning") == 1 and "Exchange" not in "".join(scan[-3:]), physical
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE cache_test")
        spark.sql(f"DROP TABLE {name}")

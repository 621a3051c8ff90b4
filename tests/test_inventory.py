"""Literal cases of the inventory operators."""

import numpy as np
from pyspark.sql import functions as F

from treesync.functions import globs, hashing, paths
from treesync.operators import batches, dedup, delta, plan, verify
from treesync.schemas import FILES
from treesync.sources import cache, listing, manifest


def files(spark, *rows):
    return spark.createDataFrame([(p, s, "sha256", h, o, 33188, m) for p, s, h, o, m in rows], FILES)


def test_groups(spark):
    rows = [("/s/a", 17, "x", 3, 1), ("/s/b", 17, "x", 1, 1), ("/s/c", 17, "x", None, 1), ("/s/d", 9, "y", None, 1), ("/s/e", 9, "y", None, 1), ("/s/f", 27, "z", 1, 1)]
    planned = dedup.plan(files(spark, *rows), "/s", "/d")
    assert dedup.stats(planned).first().asDict() == {"total_files": 6, "unique_files": 3, "duplicate_files": 3, "bytes_saved": 43}
    roles = {r["path"]: (r["role"], r["canonical_path"], r["hash"]) for r in planned.collect()}
    assert roles["/s/b"][0] == "canonical" and roles["/s/c"][1] == "/s/b" and roles["/s/e"][:2] == ("duplicate", "/s/d")
    assert roles["/s/f"] == ("unique", None, None)  # of a size of its own: no hash needed


def test_same_size_other_content_and_unhashed(spark):
    planned = dedup.plan(files(spark, ("/s/a", 7, "x", 1, 1), ("/s/b", 7, "y", 2, 1), ("/s/c", 7, None, 3, 1)), "/s", "/d")
    assert sorted(r["role"] for r in planned.collect()) == ["unhashed", "unique", "unique"]
    assert dedup.stats(planned.where("false")).first().asDict() == {"total_files": 0, "unique_files": 0, "duplicate_files": 0, "bytes_saved": 0}


def test_delta_and_orphans(spark):
    src = files(spark, ("/s/new", 1, "a", 1, 1), ("/s/same", 5, "b", 1, 7), ("/s/size", 14, "c", 1, 7), ("/s/time", 5, "d", 1, 8), ("/s/null", 5, "e", 1, None))
    dst = files(spark, ("/d/same", 5, "b", 1, 7), ("/d/size", 5, "c", 1, 7), ("/d/time", 5, "d", 1, 7), ("/d/null", 5, "e", 1, None), ("/d/gone", 5, "f", 1, 1))
    status = {r["rel_path"]: r["status"] for r in delta.mirror(src, dst, "/s", "/d").collect()}
    assert status == {"new": "new", "same": "unchanged", "size": "changed", "time": "changed", "null": "changed", "gone": "orphan"}
    assert {r["path"] for r in delta.changed(src, dst, "/s", "/d").collect()} == {"/s/new", "/s/size", "/s/time", "/s/null"}
    assert [r["path"] for r in delta.orphans(src, dst, "/s", "/d").collect()] == ["/d/gone"]


def test_globs(spark):
    rel = ["keep.txt", "skip.log", "skip.tmp", "subdir/test.log", "other/test.log", "cache/deep/x", "a1"]
    df = spark.createDataFrame([(x,) for x in rel], "r string")
    kept = lambda *p: {r["r"] for r in df.where(~globs.excluded(F.col("r"), list(p))).collect()}
    assert kept("*.log", "*.tmp") == {"keep.txt", "cache/deep/x", "a1"}
    assert kept("subdir/*.log") == set(rel) - {"subdir/test.log"}
    assert kept("cache") == set(rel) - {"cache/deep/x"}
    assert kept("[!a]*") == {"a1"}
    assert kept("**/test.log") == set(rel) - {"subdir/test.log", "other/test.log"}


def test_paths(spark):
    cases = [("/a/b/canonical.txt", "/a/b", "canonical.txt"), ("/a/b/canonical.txt", "/a/c", "../b/canonical.txt"), ("/data/store/file.dat", "/data/mnt/sub/dir", "../../../store/file.dat")]
    df = spark.createDataFrame(cases, "t string, d string, want string")
    assert all(r[0] == r[1] for r in df.select(paths.link_target(F.col("t"), F.col("d")), "want").collect())
    one = spark.createDataFrame([("/src/root/subdir/file.txt", "/srcX/a")], "a string, b string")
    assert one.select(paths.to_dest(F.col("a"), "/src/root", "/dest/root"), paths.relative(F.col("b"), "/src")).first()[:] == ("/dest/root/subdir/file.txt", "/srcX/a")


def test_hex_and_listings(spark):
    df = spark.createDataFrame([("deadbeef",), ("abc",), ("zzzz",)], "x string")
    assert [r[0] for r in df.select(hashing.from_hex(F.col("x"))).collect()] == [b"\xde\xad\xbe\xef", None, None]
    lines = spark.createDataFrame([("a" * 64 + "  one.txt",), ("b" * 64 + " *binary.dat",), ("",), ("c" * 63 + "  x",)], "value string")
    assert {r["rel_path"] for r in listing.parse_sha256(lines).collect()} == {"one.txt", "binary.dat"}


def test_resume_and_cache(spark):
    planned = spark.createDataFrame([("a", 1024, "abc"), ("b", 2048, "abc"), ("c", 1024, "def"), ("d", 1024, None), ("e", 1, None)], "rel_path string, size long, hash string")
    done = spark.createDataFrame([(x, 1024, "abc") for x in "abcd"], "rel_path string, size long, source_hash string")
    assert {r["rel_path"] for r in manifest.pending(planned, done).collect()} == {"b", "c", "e"}
    old = spark.createDataFrame([("p", 1, 1, "h", "sha256", 1)], "path string, size long, mtime long, hash string, algo string, seq int")
    new = spark.createDataFrame([("p", 2, 2, "i", "sha256", 2)], old.schema)
    assert cache.upsert(old, new, "path", ["seq"]).first()["hash"] == "i"


def test_verify_same_size_corruption(spark):
    planned = dedup.plan(files(spark, ("/s/a", 4, "x", 1, 1), ("/s/b", 4, "y", 2, 1), ("/s/c", 4, "z", 3, 1)), "/s", "/d")
    dst = files(spark, ("/d/a", 4, "x", 1, 1), ("/d/b", 4, "q", 2, 1))
    checks = verify.check(planned, dst)
    assert {r["dest_path"]: r["status"] for r in checks.collect()} == {"/d/a": "ok", "/d/b": "hash_mismatch", "/d/c": "missing_file"}
    assert verify.stats(checks, planned).first().asDict() == {"files_verified": 1, "files_failed": 2, "duplicates_skipped": 0, "exit_status": 1}


def test_batches():
    assert np.bincount(batches.greedy_batches(np.full(10, 100), 350)).tolist() == [4, 4, 2]
    assert np.bincount(batches.greedy_batches(np.full(5, 100), 1000)).tolist() == [5]
    assert len(batches.greedy_batches(np.zeros(0, int), 5)) == 0


def test_pack_round_trip(spark):
    rows = spark.createDataFrame([("s", 0, f"d/{i}.bin", bytes([i]) * 256) for i in range(3)], "shard string, batch long, rel_path string, content binary")
    out = batches.unpack(batches.pack(rows, compress=True)).collect()
    assert {(r["rel_path"], bytes(r["content"])) for r in out} == {(f"d/{i}.bin", bytes([i]) * 256) for i in range(3)}


def test_plan_index(spark):
    out = plan.with_index(files(spark, *[(f"/s/{i}", 1, "x", None if i % 3 == 0 else 100 - i, 1) for i in range(20)])).collect()
    want = sorted(out, key=lambda r: (r["physical_offset"] is None, r["physical_offset"] or 0, r["path"]))
    assert [r["plan_idx"] for r in want] == list(range(20))


def test_group_chunks_keep_large_groups(spark):
    rows = [(f"/s/{i:03}", 5, "x", None, 1) for i in range(121)] + [("/s/y", 6, "y", None, 1), ("/s/z", 6, "y", None, 1)]
    out = {(r["canonical"], r["chunk"]): r["duplicates"] for r in dedup.group_chunks(dedup.plan(files(spark, *rows), "/s", "/d"), 50).collect()}
    assert {k: len(v) for k, v in out.items()} == {("/s/000", 0): 50, ("/s/000", 1): 50, ("/s/000", 2): 20, ("/s/y", 0): 1}
    assert [p for k in range(3) for p in out["/s/000", k]] == [f"/s/{i:03}" for i in range(1, 121)]


def test_manifest_documents_are_bounded(spark):
    rows = spark.range(1000).selectExpr("concat('s/', id) AS rel_path", "id AS size", "'h' AS source_hash", "'done' AS status", "'s' AS shard")
    out = manifest.documents(rows, "shard", entries=100).select(F.size("files").alias("n")).collect()
    assert sum(r["n"] for r in out) == 1000 and len(out) == 10 and max(r["n"] for r in out) < 200

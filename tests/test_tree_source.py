"""The tree as a data source and a stream, and digests of huge files by chunks."""

import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from treesync.functions.shared import staged
from treesync.sources import scan, tree
from treesync.streaming import streams


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def source(spark):
    tree.register(spark)
    return lambda root, **o: spark.read.format("tree").options(path=str(root), **o).load()


def rows(df):
    return sorted((r["path"], r["size"], r["permissions"], r["modified_epoch"], r["error"]) for r in df.select("path", "size", "permissions", "modified_epoch", "error").collect())


@pytest.mark.parametrize("tasks", ["1", "3", "32"])
def test_equals_walk(spark, source, tmp_path, tasks):
    put(tmp_path, a="1", d__b="", d__e__c="333", d__e__f__g="4", skip__x="x", d__skip__y="y", z__skip="zz", **{f"m{i}__n": "n" for i in range(9)})
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    os.symlink(tmp_path / "nothing", tmp_path / "dangling")
    for patterns in ([], ["skip"], ["d/*", "*.x"], ["**/e", "m[0-4]"]):
        found = rows(source(tmp_path, tasks=tasks, excludes=json.dumps(patterns)))
        assert found == rows(scan.walk(spark, str(tmp_path), tuple(patterns)).withColumn("permissions", F.when(F.col("error").isNull(), F.col("permissions"))))
    with pytest.raises(Exception, match="no directory"):
        source(tmp_path / "none").count()


def test_pruned_directories_are_not_entered(spark, source, tmp_path, monkeypatch):
    put(tmp_path, keep__a="1", keep__deep__b="2", drop__c="3")
    root = str(tmp_path)
    listed, real = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda d: listed.append(d) or real(d))
    reader = tree.TreeReader(tree.Rules(root), 1)
    list(reader.pushFilters([tree.StringStartsWith(("path",), f"{root}/keep/d")]))
    found = [r[0] for p in reader.partitions() for r in reader.read(p)]
    assert found == [f"{root}/keep/deep/b"] and f"{root}/drop" not in listed
    listed.clear()
    reader = tree.TreeReader(tree.Rules(root), 1)
    list(reader.pushFilters([tree.Not(tree.StringStartsWith(("path",), f"{root}/drop/"))]))
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 2 and f"{root}/drop" not in listed
    monkeypatch.undo()
    (tmp_path / "drop" / "gone").symlink_to("/nothing")
    assert any(r[4] for r in rows(source(root))) and all(r[4] is None for r in rows(source(root).where(~F.col("path").startswith(f"{root}/drop/"))))
    assert [r[0] for r in rows(source(root).where(F.col("path").startswith(f"{root}/keep/deep")))] == [f"{root}/keep/deep/b"]


def test_new_files_feed_the_dedup_stream(spark, source, tmp_path):
    def arrive():
        time.sleep(0.3)
        files = spark.readStream.format("tree").options(path=str(tmp_path / "in"), tasks="4").load()
        hashed = scan.hash_files(files.where("error is null")).withColumn("physical_offset", F.lit(None).cast("long")).select("path", "size", "hash_algo", "hash", "physical_offset")
        streams.dedup(hashed, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
        return {os.path.basename(r["path"]): r["role"] for r in spark.read.parquet(str(tmp_path / "table" / "files")).collect()}

    put(tmp_path / "in", a="same", d__b="same", c="other")
    assert arrive() == {"a": "canonical", "b": "duplicate", "c": "canonical"}
    put(tmp_path / "in", d__e__late="other", new="new")
    assert arrive() == {"a": "canonical", "b": "duplicate", "c": "canonical", "late": "duplicate", "new": "canonical"}


def plain_tree(data, chunk, fanout):
    level = [hashlib.sha256(b"\0" + data[i : i + chunk]).digest() for i in range(0, max(len(data), 1), chunk)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + fanout])).digest() for i in range(0, len(level), fanout)]
    return hashlib.sha256(b"\2" + len(data).to_bytes(8, "big") + level[0]).hexdigest()


def test_tree_hash(spark, tmp_path):
    data = {"big": os.urandom(70_001), "empty": b"", "one": b"x" * 70, "two": b"y" * 71, "same": b"x" * 70}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    sizes = [(str(tmp_path / n), len(c)) for n, c in data.items()]
    files = spark.createDataFrame([*sizes, sizes[2], (str(tmp_path / "gone"), 5), (str(tmp_path / "one") + "/", None), (None, 3)], "path string, size long")
    chunks = staged(scan.chunk_hashes(files, 70), "chunks")
    big = chunks.where(F.col("path") == str(tmp_path / "big"))
    assert big.count() == 1001 and big.select(F.input_file_name()).distinct().count() > 4  # a thousand chunks, read by many tasks
    out = {r["path"]: r for r in scan.tree_hash(chunks, fanout=7).collect()}
    for name, content in data.items():
        r = out[str(tmp_path / name)]
        assert (r["size"], r["error"]) == (len(content), None) and r["hash"] == plain_tree(content, 70, 7)
    assert out[str(tmp_path / "big")]["hash"] == plain_tree(data["big"], 70, 7) and out[str(tmp_path / "one")]["hash"] == out[str(tmp_path / "same")]["hash"]
    assert out[str(tmp_path / "gone")]["error"] and out[None]["error"]
    changed = bytearray(data["big"])
    changed[35_000] ^= 1
    (tmp_path / "big").write_bytes(changed)
    again = staged(scan.chunk_hashes(files, 70), "chunks")
    assert [(r["path"], r["part"], r["start"]) for r in scan.changed_chunks(chunks, again, 70).collect()] == [(str(tmp_path / "big"), 500, 35_000)]
    (tmp_path / "big").write_bytes(data["big"] + b"more")
    assert scan.tree_hash(staged(scan.chunk_hashes(files.limit(1), 70), "chunks")).first()["error"]

"""Walks, hashes and whole runs over real trees, with failures."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from treesync.jobs import flows
from treesync.operators import plan
from treesync.sources import commits, manifest, runlog, scan


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_walk(spark, tmp_path):
    root = tmp_path / "src"
    put(root, a="1", d__b="", d__e__c="333", skip__x="x")
    (root / ".hidden").write_text("hh")
    os.chmod(root / "a", 0o751)
    os.symlink(root / "d" / "e", root / "linked")
    os.symlink(root, root / "d" / "loop")
    os.symlink(root / "nothing", root / "dangling")
    os.mkfifo(root / "pipe")
    rows = {r["path"].removeprefix(f"{root}/"): r for r in scan.walk(spark, str(root), ("skip",)).collect()}
    assert {k: r["size"] for k, r in rows.items() if r["error"] is None} == {"a": 1, "d/b": 0, "d/e/c": 3, ".hidden": 2, "linked/c": 3}
    assert {k for k, r in rows.items() if r["error"]} == {"d/loop", "dangling"}
    assert rows["a"]["permissions"] & 0o777 == 0o751 and rows["a"]["modified_epoch"] == int(os.stat(root / "a").st_mtime)
    rows = {r["path"].removeprefix(f"{root}/") for r in scan.walk(spark, f"file://{root}", follow_symlinks=False).collect()}
    assert rows == {"a", "d/b", "d/e/c", ".hidden", "skip/x"}


def test_walk_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan.walk(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    assert scan.walk(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(ValueError):
        scan.walk(spark, "s3://bucket/x")


def test_hashes_and_failures(spark, tmp_path):
    put(tmp_path, a="abc", empty="")
    df = spark.createDataFrame([(str(tmp_path / "a"),), (f"file://{tmp_path}/empty",), (str(tmp_path / "gone"),), (str(tmp_path),), (None,)], "path string")
    rows = {r["path"]: r for r in scan.hash_files(df).collect()}
    assert rows[str(tmp_path / "a")]["hash"].startswith("ba7816bf") and rows[f"file://{tmp_path}/empty"]["size"] == 0
    assert all(rows[p]["error"] and rows[p]["hash"] is None for p in (str(tmp_path / "gone"), str(tmp_path), None))
    import xxhash

    assert scan.hash_files(df.limit(1), "xxhash128").first()["hash"] == xxhash.xxh3_128_hexdigest(b"abc")
    with pytest.raises(ValueError):
        scan.hash_files(df, "md5")


def test_manifest_commits(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = lambda *r: spark.createDataFrame(list(r), "rel_path string, size long, source_hash string, status string")
    assert manifest.newest(spark, path).count() == 0
    manifest.record(rows(("a", 1, "x", "copied"), ("b", 1, None, "copied")), path)
    manifest.record(rows(("b", 2, "y", "linked")), path)
    manifest.record(rows(("c", 3, None, "copied")), path)
    assert {(r["rel_path"], r["size"], r["status"]) for r in manifest.newest(spark, path).collect()} == {("a", 1, "copied"), ("b", 2, "linked"), ("c", 3, "copied")}
    (tmp_path / "m" / "data" / "begun").mkdir()  # written by a job that died before its commit
    (tmp_path / "m" / "log" / "000000000003.json.x.part").write_text("{")
    assert manifest.newest(spark, path).count() == 3
    for i in range(7):
        manifest.record(rows((f"d{i}", i, None, "copied"), ("a", 10 + i, "x", "copied")), path, every=3)
    found = {r["rel_path"]: r["size"] for r in manifest.newest(spark, path).collect()}
    assert found == {"a": 16, "b": 2, "c": 3} | {f"d{i}": i for i in range(7)}
    assert len(list((tmp_path / "m" / "state").glob("*.json"))) == 2 and min(int(p.name[:12]) for p in (tmp_path / "m" / "log").glob("*.json")) > 5  # merged ones are gone
    manifest.save(rows(("z", 1, None, "copied")).withColumn("updated_at", F.lit(None).cast("timestamp")), path)
    assert [r["rel_path"] for r in manifest.newest(spark, path).collect()] == ["z"]
    manifest.remove(spark, path)
    manifest.remove(spark, path)
    assert manifest.newest(spark, path).count() == 0


def test_writers_at_once_lose_nothing(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"), "id long")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: log.append(spark.range(i, i + 1)), range(18)))
    assert sorted(numbers) == list(range(18)) and sorted(r["id"] for r in log.rows().collect()) == list(range(18))
    taken = [commits.put_if_absent(spark, str(tmp_path / "one.json"), str(i)) for i in range(3)]
    assert taken == [True, False, False] and (tmp_path / "one.json").read_text() == "0"
    assert log.checkpoint(lambda rows: rows) == 17 and log.rows().count() == 18


def test_a_killed_run_is_resumed(spark, tmp_path, monkeypatch):
    src, dst, record = tmp_path / "src", tmp_path / "dst", str(tmp_path / "m")
    put(src, **{f"d{i % 3}__f{i:02}": "x" * 1000 + str(i // 2) for i in range(40)})
    real, calls = manifest.record, []

    def dies(*args, **more):
        if len(calls) == 3:
            raise KeyboardInterrupt
        calls.append(real(*args, **more))

    monkeypatch.setattr(manifest, "record", dies)
    with pytest.raises(KeyboardInterrupt):
        flows.run(spark, str(src), str(dst), record=record, commit_bytes=5 * 66_000)
    monkeypatch.setattr(manifest, "record", real)
    done = manifest.newest(spark, record).count()
    assert 0 < done < 20 and [h["action"] for h in manifest.history(spark, record)] == ["copied"] * 3
    again = flows.run(spark, str(src), str(dst), record=record, commit_bytes=5 * 66_000, log_to=str(tmp_path / "log"))
    assert again.outcomes.where("action = 'copied'").count() == 20 - done and again.outcomes.where("action = 'linked'").count() == 20
    assert again.checks.where("status = 'ok'").count() == 20 and again.exit_status() == 0  # those of the first run too
    assert all((dst / p.relative_to(src)).read_text() == p.read_text() for p in src.rglob("f*")) and not os.path.exists(record)
    assert {(r["action"], r["count"]) for r in runlog.read(spark, str(tmp_path / "log")).groupBy("action").count().collect()} == {("copied", 20 - done), ("linked", 20), ("skipped", done)}


def test_no_room(spark, tmp_path):
    put(tmp_path / "src", a="12345", b="54321", c="1")
    room = lambda n: spark.createDataFrame([(str(tmp_path), n), ("/elsewhere", 0)], "volume string, available long")
    with pytest.raises(flows.InsufficientSpace):
        flows.run(spark, str(tmp_path / "src"), str(tmp_path / "dst"), volumes=room(10))
    assert not (tmp_path / "dst").exists()
    assert flows.run(spark, str(tmp_path / "src"), str(tmp_path / "dst"), volumes=room(11)).exit_status() == 0


def test_sizes_are_checked_before_reading(spark, tmp_path):
    put(tmp_path, a="abc", b="abc")
    df = spark.createDataFrame([(str(tmp_path / "a"), 3), (str(tmp_path / "b"), 4), (str(tmp_path / "gone"), 3)], "path string, size long")
    rows = {r["path"].rsplit("/")[-1]: (r["size"], r["hash"] is None, r["error"] is None) for r in scan.hash_files(df, expected="size").collect()}
    assert rows == {"a": (3, False, True), "b": (3, True, False), "gone": (None, True, False)}


def test_many_volumes(spark):
    volumes = spark.range(20_000).selectExpr("concat('/v', id % 200, '/w', id) AS volume").unionByName(spark.createDataFrame([("/",), ("/v7/",), (None,), ("/v7/w7/x",)], "volume string"))
    df = spark.createDataFrame([("/v7/w7/x/f",), ("/v7/w7/xy",), ("/v7/w8/z",), ("/v7",), ("rel/x",), (None,), ("/v199/w199/a/b/c",)], "path string")
    got = {r["path"]: r["at"] for r in plan.with_volume(df, "path", volumes, "at").collect()}
    assert got == {"/v7/w7/x/f": "/v7/w7/x", "/v7/w7/xy": "/v7/w7", "/v7/w8/z": "/v7", "/v7": "/", "rel/x": None, None: None, "/v199/w199/a/b/c": "/v199/w199"}


def test_runs(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    put(src, one="same", d__two="same", three="other!", four="abcd")
    (src / "broken").symlink_to(tmp_path / "nowhere")
    dry = flows.run(spark, str(src), str(dst), dry_run=True)
    assert dry.planned.count() == 4 and not dst.exists() and dry.checks.count() == 0
    done = flows.run(spark, str(src), str(dst), record=str(tmp_path / "m"))
    assert {r["path"].removeprefix(f"{src}/"): r["action"] for r in done.log().collect()} == {"d/two": "copied", "one": "linked", "three": "copied", "four": "copied", "broken": "error"}
    assert os.path.samefile(dst / "one", dst / "d" / "two") and (dst / "three").read_text() == "other!"
    assert {r["status"] for r in done.checks.collect()} == {"ok"} and done.checks.count() == 2
    again = flows.run(spark, str(src), str(dst), record=str(tmp_path / "m"))
    assert again.outcomes.count() == 0 and again.log().where("action = 'skipped'").count() == 4
    (src / "three").write_text("changed")
    (dst / "stale").write_text("x")
    third = flows.run(spark, str(src), str(dst), incremental=True, delete=True)
    assert {r["path"].removeprefix(f"{tmp_path}/"): r["action"] for r in third.outcomes.collect()} == {"src/three": "copied", "dst/stale": "deleted"}
    cache = spark.createDataFrame([(str(src / "four"), 4, int(os.stat(src / "four").st_mtime), "known")], "path string, size long, mtime long, hash string")
    hashed, failed = flows.content_hashes(scan.walk(spark, str(src)).where("error is null").drop("error"), cache)
    assert failed.count() == 0 and hashed.where(F.col("path") == str(src / "four")).first()["hash"] == "known"


def test_run_over_an_empty_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    assert flows.run(spark, str(tmp_path / "src"), str(tmp_path / "dst"), incremental=True, delete=True).log().count() == 0

"""Whole runs: a copy that links identical content, an incremental mirror, a resumed run; each with checks and a log."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.functions.globs import excluded
from treesync.functions.paths import relative
from treesync.functions.shared import mounted, staged
from treesync.operators import dedup, delta, plan, scans, verify
from treesync.schemas import LAST
from treesync.sources import cache, manifest, runlog, scan, transfer


@dataclass
class Run:
    """What a run did: its plan, an outcome per file it touched, the checks, the errors of scanning and hashing (path, error), and whether it went to its end."""

    planned: DataFrame
    outcomes: DataFrame
    checks: DataFrame
    errors: DataFrame
    whole: bool = True

    def exit_status(self) -> int:
        """0 for a whole run without any failure, else 1."""
        bad = (self.errors, self.outcomes.where("action = 'error'"), self.checks.where("status <> 'ok'"))
        return 0 if self.whole and all(x.isEmpty() for x in bad) else 1

    def log(self) -> DataFrame:
        """action, path, size, method, error: each file that was copied, linked, deleted or skipped, and each failure."""
        skipped = self.planned.join(self.outcomes.select("path"), "path", "left_anti").selectExpr("'skipped' AS action", "path", "size", "null AS method", "null AS error")
        done = self.outcomes.select("action", "path", "size", "method", "error")
        return done.unionByName(skipped).unionByName(self.errors.selectExpr("'error' AS action", "path", "cast(null AS long) AS size", "null AS method", "error"))


def content_hashes(files: DataFrame, known: DataFrame | None = None, algorithm: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(files with ``hash_algo`` and ``hash``, failures). Only files whose size occurs twice are read, and of those none that the cache ``known(path, size, mtime, hash)`` has."""
    twice = dedup.size_collisions(files).drop("hash_algo", "hash")
    looked = staged(cache.lookup(twice, known), "lookup") if known is not None else twice.withColumns({"cached_hash": F.lit(None).cast("string"), "cache_hit": F.lit(False)})
    misses = staged(looked.where(~F.col("cache_hit")).select("path"), "misses")
    read = staged(scan.hash_files(misses, algorithm, _tasks(misses)), "hashes")
    digests = read.where("hash is not null").select("path", "hash").unionByName(looked.where("cache_hit").select("path", F.col("cached_hash").alias("hash")))
    out = files.drop("hash_algo", "hash").join(digests, "path", "left").withColumn("hash_algo", F.when(F.col("hash").isNotNull(), algorithm))
    return out, read.where("error is not null").select("path", "error")


class InsufficientSpace(OSError):
    """A volume has less room than the plan needs; nothing was written."""


#: What a file costs in a commit besides its bytes: a batch of empty files must end too.
FILE_COST = 64 << 10


def _tasks(rows: DataFrame, files: int = 20_000) -> int:
    """Tasks of at most so many files, so that a lost one doesn't repeat much; ``rows`` are staged."""
    return max(rows.sparkSession.sparkContext.defaultParallelism * 4, -(-rows.count() // files))


def _batched(rows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Staged rows in physical order with ``__batch``, and the number of batches."""
    order = [F.coalesce("physical_offset", F.lit(LAST)), F.col("path")] if "physical_offset" in rows.columns else ["path"]
    weighed = rows.withColumn("__weight", F.coalesce("size", F.lit(0)) + FILE_COST)
    out = staged(scans.greedy_batches(weighed, [], order, limit, "__weight", "__batch").drop("__weight"), "batched")
    last = out.agg(F.max("__batch").alias("n")).first()["n"]
    return out, 0 if last is None else last + 1


def run(
    spark: SparkSession, src_root: str, dst_root: str, excludes: tuple[str, ...] = (), known: DataFrame | None = None, record: str | None = None,
    incremental: bool = False, delete: bool = False, dry_run: bool = False, algorithm: str = "sha256",
    volumes: DataFrame | None = None, log_to: str | None = None, commit_bytes: int = 1 << 38, most_commits: int | None = None, keep_record: bool = False,
) -> Run:
    """Bring the tree ``src_root`` to ``dst_root``: one copy of each content, links for the rest, then verify the copies.

    ``known`` is a hash cache. ``incremental`` leaves files of equal size and time alone; ``delete`` removes destination files
    without a source. ``dry_run`` only plans. Roots lie on file systems that all executors mount. Files that can't be read
    are errors in the log, and the run goes on. An empty source gives an empty run.

    ``record`` is a manifest folder. Copies, then links, go in batches of about ``commit_bytes`` (files count 64 KiB each beside
    their bytes), and each batch is committed as it ends: a run that dies, at whatever point, leaves what it had done, and the
    next one does the rest and verifies all. What the manifest has is skipped. After a run without any failure the manifest is
    removed, unless ``keep_record``. ``most_commits`` ends the run after so many batches, for a later one to go on.

    ``volumes(volume, available)``: where one has less room than the copies still to make need, ``InsufficientSpace`` is raised before
    anything is written. ``log_to`` is a folder that gets the log as JSON lines.
    """
    src_root, dst_root = mounted(src_root).rstrip("/"), mounted(dst_root).rstrip("/")
    found = scan.walk(spark, src_root, () if delete else tuple(excludes))  # orphans are judged against all of it, excluded or not
    rows = found.where("error is null").drop("error")
    wanted = rows.where(~excluded(relative(F.col("path"), src_root), list(excludes)))
    errors = found.where("error is not null").select("path", "error")
    gone = None
    if incremental or delete:
        try:
            there = scan.walk(spark, dst_root).where("error is null").drop("error")
        except FileNotFoundError:
            there = rows.limit(0)
        wanted = delta.changed(wanted, there, src_root, dst_root) if incremental else wanted
        gone = staged(delta.orphans(rows, there, src_root, dst_root), "orphans") if delete else None
    hashed, failed = content_hashes(staged(wanted, "wanted"), known, algorithm)
    planned = staged(dedup.plan(hashed, src_root, dst_root), "plan")
    errors = errors.unionByName(failed)
    if dry_run:
        none = spark.createDataFrame([], transfer.OUTCOME)
        return Run(planned, none, verify.check(planned.limit(0), planned.limit(0)), errors)
    before = staged(manifest.newest(spark, record), "manifest") if record else None
    todo = staged(manifest.pending(planned, before), "todo") if record else planned
    if volumes is not None:
        for short in plan.capacity(todo, volumes, "dest_path").where("insufficient").limit(1).collect():
            raise InsufficientSpace(f"{short['volume']} needs {short['needed']} bytes and has {short['available']}")

    parts, commits, whole = [spark.createDataFrame([], transfer.OUTCOME)], 0, True
    links = plan.links(todo, src_root, dst_root)
    for work, act, name in ((plan.copy_set(todo), transfer.copy, "copied"), (links, transfer.link, "linked")):
        work, n = _batched(work, commit_bytes)
        for batch in range(n):
            if most_commits is not None and commits == most_commits:
                whole = False
                break
            done = staged(act(work.where(F.col("__batch") == batch).drop("__batch")), name)
            parts.append(done)
            commits += 1
            if record:
                good = planned.join(done.where("action <> 'error'").select("path", "action"), "path")
                manifest.record(good.select("rel_path", "size", F.col("hash").alias("source_hash"), F.col("action").alias("status")), record, {"batch": batch, "action": name, "of": n})
    if gone is not None and whole:
        parts.append(staged(transfer.delete(gone), "deleted"))
    outcomes = staged(reduce(DataFrame.unionByName, parts), "outcomes")

    to_check = outcomes.where("action = 'copied'").select("path")
    if record:  # what an earlier run copied and could not check any more
        to_check = to_check.unionByName(planned.join(before.where("status = 'copied'").select("rel_path"), "rel_path", "left_semi").select("path"))
    tried = staged(verify.candidates(planned).join(to_check.limit(0) if not whole else to_check, "path", "left_semi"), "tried")
    copies = scan.hash_files(tried.select(F.col("dest_path").alias("path"), "size"), algorithm, _tasks(tried), expected="size").where("size is not null").select("path", "size", "hash")
    checks = staged(verify.check(tried, copies), "checks")
    out = Run(planned, outcomes, checks, errors, whole)
    if record and not tried.isEmpty():
        ok = checks.where("status = 'ok'").select("rel_path")
        manifest.record(planned.join(ok, "rel_path", "left_semi").select("rel_path", "size", F.col("hash").alias("source_hash"), F.lit("verified").alias("status")), record, {"action": "verified"})
    if log_to:
        runlog.write(out.log().withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")), log_to)
    if record and not keep_record and out.exit_status() == 0:
        manifest.remove(spark, record)
    return out

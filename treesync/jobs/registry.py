"""The registered queries of the inventory operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.functions import globs, hashing, paths
from treesync.functions.shared import mounted, new_folder, staged
from treesync.jobs import flows
from treesync.jobs.fixtures import view, with_views, write_tree
from treesync.operators import batches, dedup, delta, plan, verify
from treesync.sources import cache, listing, manifest, runlog, scan, store, tree
from treesync.streaming import streams

SRC, DST = "/src", "/dst"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def _over(view_name: str, name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query over one view."""
    query(name, sql)(lambda spark, d: f(view(spark, d, view_name)))


def _files(df: DataFrame) -> DataFrame:
    return df.select("path", "size", "hash_algo", "hash", "physical_offset", "permissions", "modified_epoch")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return dedup.plan(_files(view(spark, d, "src_files")), SRC, DST)


#: The plan in SQL; later queries build on it.
PLAN = """
WITH s AS (SELECT *, count(*) OVER (PARTITION BY size) AS n_size, count(*) OVER (PARTITION BY size, hash) AS n_hash,
  first_value(path) OVER (PARTITION BY size, hash ORDER BY physical_offset ASC NULLS LAST, path) AS first FROM src_files),
p AS (SELECT path, size, CASE WHEN n_size > 1 THEN hash END AS hash, physical_offset, substring(path, 6) AS rel_path, concat('/dst/', substring(path, 6)) AS dest_path,
  CASE WHEN n_hash = 1 THEN 'unique' WHEN first = path THEN 'canonical' ELSE 'duplicate' END AS role, CASE WHEN n_hash > 1 THEN first END AS canonical_path, content FROM s)
"""

# Sources and sinks



def _tree(spark: SparkSession, d: str, name: str = "tree_files", where: str = "true", root: str | None = None) -> str:
    """A view of files, or some of it, as a tree in the shared folder."""
    return write_tree(view(spark, d, name).where(where), root or new_folder(spark, "tree"))


@query("tree_source", "SELECT rel_path, cast(strlen(content) AS bigint) AS size, permissions, modified_epoch FROM tree_files WHERE rel_path NOT LIKE '%7.txt' AND rel_path LIKE 'src1%'")
def tree_source(spark: SparkSession, d: str) -> DataFrame:
    """The inventory as a data source, with a filter on the path that prunes the walk."""
    root = _tree(spark, d)
    tree.register(spark)
    found = spark.read.format("tree").options(path=root, excludes='["*7.txt"]').load().where(F.col("path").startswith(f"{root}/src1"))
    return found.select(paths.relative(F.col("path"), root).alias("rel_path"), "size", F.col("permissions").cast("int").alias("permissions"), "modified_epoch")


@query("read_tree_hash")
def read_tree_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests of files by a tree over chunks, here of 1 KiB: a file of many chunks is read by many tasks."""
    root = _tree(spark, d)
    chunks = staged(scan.chunk_hashes(scan.walk(spark, root), 1 << 10), "chunks")
    return scan.tree_hash(chunks).select(paths.relative(F.col("path"), root).alias("rel_path"), "size", "hash", F.col("error").isNotNull().alias("failed"))


@query("scan_inventory", "SELECT rel_path, cast(strlen(content) AS bigint) AS size, permissions, modified_epoch FROM tree_files WHERE rel_path NOT LIKE '%7.txt'")
def scan_inventory(spark: SparkSession, d: str) -> DataFrame:
    root = _tree(spark, d)
    return scan.walk(spark, root, ("*7.txt",)).select(paths.relative(F.col("path"), root).alias("rel_path"), "size", "permissions", "modified_epoch")


@query("read_content_hash", "SELECT rel_path, cast(strlen(content) AS bigint) AS size, sha256(content) AS hash, false AS failed FROM tree_files UNION ALL SELECT concat(rel_path, '.gone'), NULL, NULL, true FROM tree_files WHERE doc_id % 41 = 0")
def read_content_hash(spark: SparkSession, d: str) -> DataFrame:
    root = _tree(spark, d)
    gone = view(spark, d, "tree_files").where("doc_id % 41 = 0").select(F.concat(F.lit(root + "/"), "rel_path", F.lit(".gone")).alias("path"))
    out = scan.hash_files(scan.walk(spark, root).select("path").unionByName(gone))
    return out.select(paths.relative(F.col("path"), root).alias("rel_path"), "size", "hash", F.col("error").isNotNull().alias("failed"))


_over(
    "listing", "read_sha256_listing",
    "SELECT CASE WHEN doc_id % 10 = 0 THEN substring(value, 67) ELSE trim(substring(value, 67)) END AS rel_path, 'sha256' AS hash_algo, substring(value, 1, 64) AS hash FROM listing WHERE doc_id % 10 NOT IN (1, 2, 3)",
    lambda x: listing.parse_sha256(x).select("rel_path", "hash_algo", hashing.to_hex(F.col("hash")).alias("hash")),
)
_over(
    "listing", "read_xxhsum_listing",
    "SELECT trim(substring(value, 67)) AS rel_path, 'xxhash128' AS hash_algo, substring(value, 1, 32) AS hash FROM listing WHERE doc_id % 10 > 3",
    lambda x: listing.parse_xxhsum(x.withColumn("value", F.when(F.col("value").rlike("^[0-9a-f]{64}  "), F.concat(F.substring("value", 1, 32), F.substring("value", 65, 1 << 30))).otherwise(F.col("value")))).select("rel_path", "hash_algo", hashing.to_hex(F.col("hash")).alias("hash")),
)
_over(
    "src_files", "read_json_hash_listing",
    "SELECT path AS rel_path, 'sha256' AS hash_algo, hash FROM src_files WHERE doc_id % 7 > 1",
    lambda x: listing.parse_json(
        x.select(F.when(F.col("doc_id") % 7 == 0, "not json").when(F.col("doc_id") % 7 == 1, F.to_json(F.struct("path", F.substring("hash", 1, 10).alias("hash")))).otherwise(F.to_json(F.struct("path", "hash"))).alias("value")), "sha256"
    ).select("rel_path", "hash_algo", hashing.to_hex(F.col("hash")).alias("hash")),
)


@query("manifest_load", "SELECT rel_path, size, source_hash, status FROM manifest")
def manifest_load(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "manifest-json")
    rows = view(spark, d, "manifest").withColumn("shard", F.split("rel_path", "/")[0])
    manifest.documents(rows, "shard").write.json(folder)
    return manifest.load(spark, folder, lines=True).select("rel_path", "size", "source_hash", "status")


@query("manifest_save", "SELECT rel_path, size, source_hash, status FROM manifest")
def manifest_save(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "manifest").withColumn("updated_at", F.lit(None).cast("timestamp"))
    folder = new_folder(spark, "manifest")
    manifest.save(rows.where("size % 2 = 0").withColumn("status", F.lit("old")), folder)
    manifest.record(rows, folder)
    return manifest.newest(spark, folder).select("rel_path", "size", "source_hash", "status")


def _cache_table(spark: SparkSession, rows: DataFrame) -> str:
    """A bucketed table with a name of its own."""
    name = f"hash_cache__{uuid.uuid4().hex}"
    cache.write(rows, name, 8)
    return name


@query("cache_table", "SELECT path, size, mtime, hash, algo FROM (SELECT *, CASE WHEN seq = 1 THEN 'blake3' ELSE algo END AS a FROM hash_cache) WHERE a = 'blake3' OR size % 3 <> 0")
def cache_table(spark: SparkSession, d: str) -> DataFrame:
    """Written to a bucketed table and read from it; rows of an unknown algorithm are left out."""
    algo = F.when(F.col("seq") == 1, "blake3").when(F.col("size") % 3 == 0, "md5").otherwise("sha256")
    name = _cache_table(spark, view(spark, d, "hash_cache").withColumn("algo", algo).withColumn("hash", hashing.from_hex(F.col("hash"))))
    return cache.read(spark, name).select("path", "size", "mtime", hashing.to_hex(F.col("hash")).alias("hash"), F.lit("sha256").alias("algo"))


@query("run_log_write", "SELECT run, seq, action, path, size FROM run_log")
def run_log_write(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "log")
    runlog.write(view(spark, d, "run_log"), folder)
    return runlog.read(spark, folder).select("run", "seq", "action", "path", "size")


@query("run_log_read", "SELECT action, count(*) AS n_rows, cast(sum(size) AS bigint) AS bytes FROM run_log GROUP BY action")
def run_log_read(spark: SparkSession, d: str) -> DataFrame:
    return run_log_write(spark, d).groupBy("action").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))


def _stored(spark: SparkSession, d: str) -> str:
    """The folder of a store of the source files; the plan is made of narrow rows."""
    folder, src = new_folder(spark, "store"), view(spark, d, "src_files").drop("doc_id", "shard")
    store.write(dedup.plan(src.drop("content"), SRC, DST), src.select("path", "content"), folder)
    return folder


@query("write_dedup_store", PLAN + "SELECT count(*) AS blobs, cast(sum(size) AS bigint) AS bytes, (SELECT count(*) FROM p) AS links FROM p WHERE role <> 'duplicate'")
def write_dedup_store(spark: SparkSession, d: str) -> DataFrame:
    folder = _stored(spark, d)
    blobs, links = spark.read.parquet(f"{folder}/blobs"), spark.read.parquet(f"{folder}/links")
    both = blobs.select(F.lit(1).alias("blob"), "size").unionByName(links.select(F.lit(0).alias("blob"), F.lit(0).cast("long").alias("size")))
    return both.agg(F.sum("blob").alias("blobs"), F.sum("size").alias("bytes"), F.count_if(F.col("blob") == 0).alias("links"))


@query("restore_from_store", "SELECT concat('/dst/', substring(path, 6)) AS dest_path, size, hash FROM src_files")
def restore_from_store(spark: SparkSession, d: str) -> DataFrame:
    folder = _stored(spark, d)
    return store.restore(spark, folder).select("dest_path", "size", F.sha2("content", 256).alias("hash"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    src = view(spark, d, "src_files").withColumn("rel_path", paths.relative(F.col("path"), SRC))
    batched = batches.by_bytes(src.select("path", "rel_path", "size", "shard"), 1 << 20)
    return batches.pack(batched.join(src.select("path", "content"), "path"), compress=True)


@query("pack_small_files")
def pack_small_files(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("shard", "batch", F.octet_length("archive").alias("bytes"))


@query("unpack", "SELECT substring(path, 6) AS rel_path, hash FROM src_files")
def unpack(spark: SparkSession, d: str) -> DataFrame:
    return batches.unpack(_packed(spark, d)).select("rel_path", F.sha2("content", 256).alias("hash"))


# Projections and predicates

PATTERNS = ["*.tmp", "src1/*", "de"]
_over("src_files", "exclude_globs", "SELECT path FROM src_files WHERE NOT (path LIKE '%.tmp' OR path LIKE '/src/src1/%' OR path LIKE '/src/%/de/%')", lambda x: globs.exclude(x, SRC, PATTERNS).select("path"))
_over("src_files", "relative_path", "SELECT path, CASE WHEN path LIKE '/src/src1/%' THEN substring(path, 11) ELSE path END AS rel_path FROM src_files", lambda x: x.select("path", paths.relative(F.col("path"), "/src/src1").alias("rel_path")))
_over("src_files", "map_source_to_dest", "SELECT path, CASE WHEN path LIKE '/src/src1/%' THEN concat('/dst/', substring(path, 11)) ELSE path END AS dest_path FROM src_files", lambda x: x.select("path", paths.to_dest(F.col("path"), "/src/src1", DST).alias("dest_path")))
_over("src_files", "size_class", "SELECT path, CASE WHEN size < 2048 THEN 'small' ELSE 'large' END AS class FROM src_files", lambda x: x.select("path", plan.size_class(F.col("size"), 2048).alias("class")))
_over("dst_files", "skip_metadata_files", "SELECT path FROM dst_files WHERE path NOT LIKE '/dst/stale/%' AND path NOT LIKE '%/7%.%'", lambda x: globs.skip_prefix(globs.skip_prefix(x, DST, "stale"), DST, "7").select("path"))
query("physical_copy_set", PLAN + "SELECT path, role FROM p WHERE role <> 'duplicate'")(lambda spark, d: plan.copy_set(_plan(spark, d)).select("path", "role"))
query("no_dedup_plan", "SELECT count(*) AS total_files, count(*) AS unique_files, 0::BIGINT AS duplicate_files, 0::BIGINT AS bytes_saved FROM src_files")(lambda spark, d: dedup.stats(dedup.plan(_files(view(spark, d, "src_files")), SRC, DST, dedup=False)))
query("force_mode", "SELECT path, size FROM src_files")(lambda spark, d: delta.changed(view(spark, d, "src_files"), view(spark, d, "dst_files"), SRC, DST, force=True).select("path", "size"))
query("verify_candidates", PLAN + "SELECT path, role FROM p WHERE role <> 'duplicate' AND hash IS NOT NULL")(lambda spark, d: verify.candidates(_plan(spark, d)).select("path", "role"))

# Joins

_over("src_files", "size_collision_filter", "SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM src_files) WHERE n > 1", lambda x: dedup.size_collisions(x).select("path", "size"))
SAME = "coalesce(s.size = d.size AND s.modified_epoch = d.modified_epoch, false)"
query("compute_delta", f"SELECT s.path FROM src_files s LEFT JOIN dst_files d ON substring(s.path, 6) = substring(d.path, 6) WHERE NOT {SAME}")(lambda spark, d: delta.changed(view(spark, d, "src_files"), view(spark, d, "dst_files"), SRC, DST).select("path"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return delta.orphans(view(spark, d, "src_files"), view(spark, d, "dst_files"), SRC, DST)


query("find_orphans", "SELECT path, size FROM dst_files WHERE substring(path, 6) NOT IN (SELECT substring(path, 6) FROM src_files)")(lambda spark, d: _orphans(spark, d).select("path", "size"))


def _mirror(spark: SparkSession, d: str) -> DataFrame:
    return delta.mirror(view(spark, d, "src_files"), view(spark, d, "dst_files"), SRC, DST)


MIRROR = f"""
WITH m AS (SELECT coalesce(substring(s.path, 6), substring(d.path, 6)) AS rel_path, coalesce(s.size, d.size) AS bytes,
  CASE WHEN s.path IS NULL THEN 'orphan' WHEN d.path IS NULL THEN 'new' WHEN {SAME} THEN 'unchanged' ELSE 'changed' END AS status
FROM src_files s FULL JOIN dst_files d ON substring(s.path, 6) = substring(d.path, 6))
"""
query("mirror_diff", MIRROR + "SELECT rel_path, status FROM m")(lambda spark, d: _mirror(spark, d).select("rel_path", "status"))
query("delta_counts", MIRROR + "SELECT status, count(*) AS files, cast(sum(bytes) AS bigint) AS bytes FROM m GROUP BY status")(lambda spark, d: delta.counts(_mirror(spark, d)))
query("apply_deletes", "SELECT path FROM dst_files WHERE substring(path, 6) IN (SELECT substring(path, 6) FROM src_files)")(lambda spark, d: delta.apply_deletes(view(spark, d, "dst_files"), _orphans(spark, d)).select("path"))


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    """Against a bucketed table of all cache rows, the last of each path staying."""
    rows = view(spark, d, "hash_cache")
    name = cache.renew(spark, _cache_table(spark, rows.where("seq = 1")), rows.where("seq = 2"), ["seq"], 8)
    return cache.lookup(view(spark, d, "src_files").drop("content"), spark.table(name))


LOOKUP = "WITH l AS (SELECT s.path, s.size, s.hash, c.hash AS cached FROM src_files s LEFT JOIN (SELECT * FROM hash_cache QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) c ON s.path = c.path AND s.size = c.size AND s.modified_epoch = c.mtime)"
query("cache_lookup", LOOKUP + "SELECT path, coalesce(cached, hash) AS hash, cached IS NOT NULL AS cache_hit FROM l")(lambda spark, d: _lookup(spark, d).select("path", F.coalesce("cached_hash", "hash").alias("hash"), "cache_hit"))
query("hash_stats", LOOKUP + "SELECT count(*) FILTER (cached IS NULL AND size % 50 <> 0) AS files_hashed, cast(sum(size) FILTER (cached IS NULL AND size % 50 <> 0) AS bigint) AS bytes_hashed, count(cached) AS cache_hits, count(*) FILTER (size % 50 = 0 AND cached IS NULL) AS errors FROM l")(
    lambda spark, d: hashing.stats(
        _lookup(spark, d).withColumn("error", F.when((F.col("size") % 50 == 0) & ~F.col("cache_hit"), "unreadable")).withColumn("hash", F.when(F.col("error").isNull(), F.col("hash")))
    )
)
query("resume_filter", PLAN + "SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.rel_path = p.rel_path AND m.size = p.size AND (m.source_hash IS NULL OR p.hash IS NULL OR m.source_hash = p.hash))")(
    lambda spark, d: manifest.pending(_plan(spark, d), view(spark, d, "manifest")).select("path")
)
CHECKS = PLAN + """, v AS (SELECT p.rel_path, p.dest_path, p.size, p.hash, d.size AS d_size, d.hash AS d_hash,
  CASE WHEN d.path IS NULL THEN 'missing_file' WHEN p.size <> d.size THEN 'size_mismatch' WHEN d.hash IS NULL THEN 'io' WHEN p.hash <> d.hash THEN 'hash_mismatch' ELSE 'ok' END AS status
FROM p LEFT JOIN dst_files d ON d.path = p.dest_path WHERE role <> 'duplicate' AND p.hash IS NOT NULL)
"""


def _checks(spark: SparkSession, d: str) -> DataFrame:
    return verify.check(_plan(spark, d), view(spark, d, "dst_files"))


query("verify_join", CHECKS + "SELECT dest_path, status, CASE status WHEN 'size_mismatch' THEN cast(size AS varchar) WHEN 'hash_mismatch' THEN hash END AS expected, CASE status WHEN 'size_mismatch' THEN cast(d_size AS varchar) WHEN 'hash_mismatch' THEN d_hash END AS actual FROM v")(
    lambda spark, d: _checks(spark, d).drop("rel_path")
)
query("verify_stats", CHECKS + "SELECT count(*) FILTER (status = 'ok') AS files_verified, count(*) FILTER (status <> 'ok') AS files_failed, (SELECT count(*) FROM p WHERE role = 'duplicate') AS duplicates_skipped, 1 AS exit_status FROM v")(
    lambda spark, d: verify.stats(_checks(spark, d), _plan(spark, d))
)
query("mark_verified", CHECKS + "SELECT m.rel_path, CASE WHEN v.status = 'ok' THEN 'verified' ELSE m.status END AS status FROM manifest m LEFT JOIN v ON v.rel_path = m.rel_path")(
    lambda spark, d: manifest.mark_verified(view(spark, d, "manifest"), _checks(spark, d)).select("rel_path", "status")
)


def _links(spark: SparkSession, d: str) -> DataFrame:
    return plan.links(_plan(spark, d), SRC, DST)


LINKS = PLAN + ", l AS (SELECT path, dest_path, concat('/dst/', substring(canonical_path, 6)) AS canonical_dest, size, string_split(dest_path, '/') AS dp, string_split(concat('/dst/', substring(canonical_path, 6)), '/') AS cp FROM p WHERE role = 'duplicate')"
#: Paths have five components here: the climb depends on how many of the third and fourth are shared.
TARGET = "CASE WHEN dp[3] <> cp[3] THEN concat('../../', cp[3], '/', cp[4], '/', cp[5]) WHEN dp[4] <> cp[4] THEN concat('../', cp[4], '/', cp[5]) ELSE cp[5] END"
query("link_map", LINKS + f"SELECT path, canonical_dest, {TARGET} AS link_target FROM l")(lambda spark, d: _links(spark, d).select("path", "canonical_dest", "link_target"))
query("relative_link_target", LINKS + f"SELECT dest_path, {TARGET} AS link_target FROM l")(lambda spark, d: _links(spark, d).select("dest_path", paths.link_target(F.col("canonical_dest"), paths.dirname(F.col("dest_path"))).alias("link_target")))


def _dst_volumes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "volumes").withColumn("volume", F.regexp_replace("volume", "^/src", "/dst"))


query("link_method", LINKS + "SELECT path, CASE WHEN dp[3] = cp[3] THEN 'linked' ELSE 'fallback_copied' END AS method, CASE WHEN dp[3] = cp[3] THEN 0 ELSE size END AS bytes_written FROM l")(
    lambda spark, d: plan.link_method(_links(spark, d), _dst_volumes(spark, d), symlinks=False).select("path", "method", "bytes_written")
)
query("attach_listing_hashes", "SELECT s.path, CASE WHEN s.doc_id % 10 NOT IN (1, 2, 3) THEN s.hash END AS hash FROM src_files s")(
    lambda spark, d: listing.attach(view(spark, d, "src_files"), listing.parse_sha256(view(spark, d, "listing")), SRC)[0].select("path", hashing.to_hex(F.col("hash")).alias("hash"))
)
query("capacity_check", PLAN + "SELECT volume, needed, available, coalesce(available < needed, false) AS insufficient FROM (SELECT concat('/src/', string_split(path, '/')[3]) AS volume, cast(sum(size) AS bigint) AS needed FROM p WHERE role <> 'duplicate' GROUP BY 1) JOIN volumes USING (volume)")(
    lambda spark, d: plan.capacity(_plan(spark, d), view(spark, d, "volumes"))
)

# Aggregations

query("hash_groups", "SELECT size, hash, count(*) AS members, first(path ORDER BY physical_offset ASC NULLS LAST, path) AS canonical_path FROM src_objects GROUP BY size, hash HAVING count(*) > 1")(
    lambda spark, d: dedup.hash_groups(view(spark, d, "src_objects")).select("size", "hash", "members", "canonical_path")
)
query("dedup_stats", PLAN + "SELECT count(*) AS total_files, count(*) FILTER (role <> 'duplicate') AS unique_files, count(*) FILTER (role = 'duplicate') AS duplicate_files, cast(coalesce(sum(size) FILTER (role = 'duplicate'), 0) AS bigint) AS bytes_saved FROM p")(lambda spark, d: dedup.stats(_plan(spark, d)))
query("plan_totals", PLAN + "SELECT cast(sum(size) AS bigint) AS total_bytes, count(*) FILTER (role = 'duplicate') AS link_count, cast(sum(size) FILTER (role <> 'duplicate') AS bigint) AS physical_bytes FROM p")(lambda spark, d: plan.totals(_plan(spark, d)))
query("dry_run_report", PLAN + "SELECT count(*) AS entries, cast(sum(size) AS bigint) AS total_bytes, count(*) FILTER (role = 'duplicate') AS links, cast(coalesce(sum(size) FILTER (role = 'duplicate'), 0) AS bigint) AS bytes_saved FROM p")(lambda spark, d: plan.dry_run(_plan(spark, d)))
_over(
    "run_log", "copy_stats",
    """WITH o AS (SELECT action, size, CASE seq % 4 WHEN 0 THEN 'linked' WHEN 1 THEN 'cloned' WHEN 2 THEN 'symlinked' ELSE 'fallback_copied' END AS method FROM run_log),
    t AS (SELECT count(*) FILTER (action = 'copied') AS files_copied, count(*) FILTER (action = 'linked' AND method = 'linked') AS files_linked, count(*) FILTER (action = 'linked' AND method = 'cloned') AS files_cloned,
    count(*) FILTER (action = 'linked' AND method = 'symlinked') AS files_symlinked, count(*) FILTER (action = 'linked' AND method = 'fallback_copied') AS files_fallback_copied, count(*) FILTER (action = 'skipped') AS files_skipped,
    count(*) FILTER (action = 'error') AS files_errored, cast(sum(size) FILTER (action = 'copied' OR (action = 'linked' AND method = 'fallback_copied')) AS bigint) AS bytes_written, cast(sum(size) FILTER (action = 'linked' AND method <> 'fallback_copied') AS bigint) AS bytes_saved FROM o)
    SELECT *, bytes_written / 2.0::DOUBLE AS throughput FROM t""",
    lambda x: plan.copy_stats(x.withColumn("method", F.element_at(F.array(*map(F.lit, ("linked", "cloned", "symlinked", "fallback_copied"))), (F.col("seq") % 4 + 1).cast("int"))), 2.0),
)
SUMMARY = "SELECT run, count(*) FILTER (action = 'copied') AS files_copied, count(*) FILTER (action = 'linked') AS files_linked, count(*) FILTER (action = 'skipped') AS files_skipped, count(*) FILTER (action = 'error') AS files_errored, cast(coalesce(sum(size) FILTER (action = 'copied'), 0) AS bigint) AS bytes_written FROM run_log GROUP BY run"
_over("run_log", "log_summary", SUMMARY, runlog.summary)
query("manifest_progress", "SELECT status, count(*) AS files FROM manifest GROUP BY status")(lambda spark, d: manifest.progress(view(spark, d, "manifest")))

# Windows, order and batches

_over("src_files", "physical_order", "SELECT path, physical_offset FROM src_files", lambda x: plan.physical_order(x).select("path", "physical_offset"))
query("canonical_pick", PLAN + "SELECT path, canonical_path FROM p WHERE canonical_path IS NOT NULL")(lambda spark, d: _plan(spark, d).where("canonical_path is not null").select("path", "canonical_path"))
_over("src_files", "plan_index", "SELECT path, row_number() OVER (ORDER BY physical_offset ASC NULLS LAST, path) - 1 AS plan_idx FROM src_files", lambda x: plan.with_index(x.select("path", "physical_offset")).select("path", "plan_idx"))
BATCHES = """
WITH RECURSIVE o AS (SELECT path, size, shard, row_number() OVER (PARTITION BY shard ORDER BY path) AS i FROM src_files),
b AS (SELECT path, size, shard, i, 0 AS batch, size AS run FROM o WHERE i = 1
  UNION ALL SELECT o.path, o.size, o.shard, o.i, CASE WHEN b.run >= 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.run >= 20000 THEN o.size ELSE b.run + o.size END FROM b JOIN o ON o.shard = b.shard AND o.i = b.i + 1)
"""
_over("src_files", "byte_batches", BATCHES + "SELECT path, cast(batch AS bigint) AS batch FROM b", lambda x: batches.by_bytes(x.select("path", "size", "shard"), 20000).select("path", "batch"))
_over("src_files", "batch_totals", BATCHES + "SELECT shard, cast(batch AS bigint) AS batch, count(*) AS files, cast(sum(size) AS bigint) AS bytes FROM b GROUP BY shard, batch", lambda x: batches.totals(batches.by_bytes(x.drop("content"), 20000)).drop("sub_shard"))
_over("src_files", "count_batches", "SELECT path, cast((row_number() OVER (PARTITION BY shard ORDER BY path) - 1) // 7 AS bigint) AS batch FROM src_files", lambda x: batches.by_count(x, SRC, 7).select("path", "batch"))
_over(
    "run_log", "running_progress",
    "SELECT run, seq, row_number() OVER w AS files_done, cast(sum(size) OVER w AS bigint) AS bytes_done, count(*) OVER (PARTITION BY run) AS files_total, cast(sum(size) OVER (PARTITION BY run) AS bigint) AS bytes_total FROM run_log WINDOW w AS (PARTITION BY run ORDER BY seq)",
    lambda x: runlog.progress(x, ["run"], ["seq"]).select("run", "seq", "files_done", "bytes_done", "files_total", "bytes_total"),
)
UPSERT = "SELECT path, size, mtime, hash, algo, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM hash_cache) WHERE r = 1"


@query("latest_wins_upsert", UPSERT)
def latest_wins_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "hash_cache")
    return cache.upsert(rows.where("seq = 1"), rows.where("seq = 2"), "path", ["seq"])


# Set operations

query("assemble_plan", PLAN + "SELECT path, role, hash FROM p")(lambda spark, d: _plan(spark, d).select("path", "role", "hash"))


@query("merge_listings", "SELECT path AS rel_path, CASE WHEN doc_id % 3 = 0 THEN sha256(path) ELSE hash END AS hash FROM src_files")
def merge_listings(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "src_files").select("doc_id", F.col("path").alias("rel_path"), "hash_algo", "hash")
    second = rows.where("doc_id % 3 = 0").withColumn("hash", F.sha2("rel_path", 256))
    return listing.merge(rows.drop("doc_id"), second.drop("doc_id")).select("rel_path", "hash")


query("cache_evict", "SELECT c.path, c.seq FROM hash_cache c WHERE c.path IN (SELECT path FROM src_files WHERE doc_id % 4 <> 0)")(
    lambda spark, d: cache.evict(view(spark, d, "hash_cache"), view(spark, d, "src_files").where("doc_id % 4 <> 0")).select("path", "seq")
)

# Scalars

_over("src_files", "hash_bytes", "SELECT path, hash FROM src_files", lambda x: x.select("path", hashing.to_hex(hashing.digest(F.col("content").cast("binary"))).alias("hash")))
_over("src_files", "hash_bytes_xxh3", None, lambda x: x.select("path", hashing.to_hex(hashing.digest(F.col("content").cast("binary"), "xxhash128")).alias("hash")))
_over("src_files", "hash_hex", "SELECT path, lower(hex(path)) AS text FROM src_files", lambda x: x.select("path", hashing.to_hex(F.col("path").cast("binary")).alias("text")))
_over("listing", "hex_to_bytes", "SELECT doc_id, CASE WHEN doc_id % 10 IN (1, 2, 3) THEN CASE WHEN doc_id % 10 = 2 THEN 0 END ELSE 32 END AS n_bytes FROM listing", lambda x: x.select("doc_id", F.octet_length(hashing.from_hex(F.split("value", " ")[0])).alias("n_bytes")))
_over("src_files", "hash_valid", "SELECT path, doc_id % 3 = 0 AS valid FROM src_files", lambda x: x.select("path", hashing.valid(F.when(F.col("doc_id") % 3 == 1, "xxhash128").when(F.col("doc_id") % 3 == 2, "md5").otherwise("sha256"), F.unhex("hash")).alias("valid")))
_over("src_files", "mode_octal", "SELECT path, CASE WHEN permissions = 33261 THEN '755' ELSE '644' END AS mode FROM src_files", lambda x: x.select("path", plan.mode_octal(F.col("permissions")).alias("mode")))
_over("src_files", "epoch_rfc3339", "SELECT path, strftime(make_timestamp(modified_epoch * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at_time, modified_epoch AS epoch FROM src_files", lambda x: x.select("path", plan.rfc3339(F.col("modified_epoch")).alias("at_time")).withColumn("epoch", plan.epoch(F.to_timestamp("at_time"))))
_over("src_files", "basename_dirname", "SELECT path, string_split(path, '/')[5] AS name, concat('/src/', string_split(path, '/')[3], '/', string_split(path, '/')[4]) AS parent FROM src_files", lambda x: x.select("path", paths.basename(F.col("path")).alias("name"), paths.dirname(F.col("path")).alias("parent")))
query("nested_group_export", PLAN + ", n AS (SELECT canonical_path, path, (row_number() OVER (PARTITION BY canonical_path ORDER BY path) - 1) // 1000 AS part FROM p WHERE role = 'duplicate') SELECT canonical_path AS canonical, cast(part AS bigint) AS part, string_agg(path, ',' ORDER BY path) AS duplicates FROM n GROUP BY canonical_path, part")(
    lambda spark, d: dedup.group_chunks(_plan(spark, d), 1000).select("canonical", F.col("chunk").alias("part"), F.array_join("duplicates", ",").alias("duplicates"))
)
query("nested_group_chunks", PLAN + ", n AS (SELECT canonical_path, path, (row_number() OVER (PARTITION BY canonical_path ORDER BY path) - 1) // 50 AS chunk FROM p WHERE role = 'duplicate') SELECT canonical_path AS canonical, cast(chunk AS bigint) AS chunk, string_agg(path, ',' ORDER BY path) AS duplicates FROM n GROUP BY canonical_path, chunk")(
    lambda spark, d: dedup.group_chunks(_plan(spark, d), 50).select("canonical", "chunk", F.array_join("duplicates", ",").alias("duplicates"))
)

# Streams: the rows arrive as files, and the final state is what the batch operator gives


def _arrive(spark: SparkSession, rows: DataFrame, by: str) -> DataFrame:
    """``rows`` as a stream of files, ordered by a small number in the column ``by``."""
    folder = new_folder(spark, "arrivals")
    for value in (0, 1):
        rows.where(F.col(by) == value).drop(by).coalesce(4).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop(by).schema).option("maxFilesPerTrigger", 4).parquet(folder)


def _summed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a streaming aggregate to its end; each trigger's result replaces the table."""
    folder = new_folder(spark, name)
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/out")
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_log_summary", SUMMARY)
def stream_log_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "run_log").withColumn("half", (F.col("seq") % 2).cast("int"))
    return _summed(spark, streams.log_summary(_arrive(spark, rows, "half")), "log-summary")


@query("stream_progress", "SELECT run, action AS phase, max(seq) AS files_done, max(size) AS bytes_done FROM run_log GROUP BY run, action")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    progress = F.struct(F.col("seq").alias("files_done"), F.col("size").alias("bytes_done")).alias("progress")
    rows = view(spark, d, "run_log").select("run", F.col("action").alias("phase"), progress, (F.col("seq") % 2).cast("int").alias("half"))
    return _summed(spark, streams.progress(_arrive(spark, rows, "half")), "progress")


@query(
    "stream_log_windows",
    """SELECT cast(floor(epoch(ts) / 3600) AS bigint) * 3600 AS start, user_id AS run, count(*) FILTER (event_type = 'view') AS files_copied, count(*) FILTER (event_type = 'click') AS files_linked,
  count(*) FILTER (event_type = 'purchase') AS files_skipped, count(*) FILTER (event_type = 'error') AS files_errored,
  coalesce(cast(sum(cast(floor(value * 100) AS bigint)) FILTER (event_type = 'view') AS bigint), 0) AS bytes_written FROM events GROUP BY 1, 2""",
)
def stream_log_windows(spark: SparkSession, d: str) -> DataFrame:
    """The log in hours of its lines' own times. A fifth of the lines come twice, and those of the last twelve hours before the middle of the time come again in the second half."""
    log = view(spark, d, "timed_log")
    first, last = log.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
    at, middle = F.unix_micros("at"), ((first or 0) + (last or 0)) // 2
    half = (at >= middle).cast("int")
    again = F.when(F.col("seq") % 5 == 0, F.array(half, half)).otherwise(F.array(half))
    overlap = F.when((half == 0) & (at > middle - 12 * 3600 * 10**6), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    rows, folder = log.withColumn("half", F.explode(F.concat(again, overlap))).drop("at"), new_folder(spark, "log-windows")
    streams.log_windows(_arrive(spark, rows, "half"), f"{folder}/table", f"{folder}/state", late="12 hours").awaitTermination()
    return streams.window_state(spark, f"{folder}/table").withColumn("start", F.unix_timestamp("start"))


@query("stream_cache_upsert", UPSERT)
def stream_cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows, folder = view(spark, d, "hash_cache"), new_folder(spark, "cache")
    streams.cache_upsert(_arrive(spark, rows.withColumn("half", F.col("seq") - 1), "half"), f"{folder}/table", f"{folder}/state").awaitTermination()
    return streams.cache_state(spark, f"{folder}/table", rows.schema)


@query("stream_dedup", "SELECT count(*) AS files, count(DISTINCT (size, hash)) AS canonicals, count(*) - count(DISTINCT (size, hash)) AS duplicates, cast(sum(size) - (SELECT sum(size) FROM (SELECT DISTINCT size, hash FROM src_files)) AS bigint) AS bytes_saved FROM src_files")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows, folder = _files(view(spark, d, "src_files")), new_folder(spark, "dedup")
    half = F.pmod(F.xxhash64("path"), F.lit(2)).cast("int")
    streams.dedup(_arrive(spark, rows.withColumn("half", half), "half"), f"{folder}/table", f"{folder}/state").awaitTermination()
    copies = F.col("role") == "duplicate"
    return spark.read.parquet(f"{folder}/table/files").agg(
        F.count("*").alias("files"), F.count_if(~copies).alias("canonicals"), F.count_if(copies).alias("duplicates"), F.coalesce(F.sum(F.when(copies, F.col("size"))), F.lit(0)).alias("bytes_saved")
    )


# Whole runs over trees of files

#: The tree with its roles, as ``PLAN``; ``{rows}`` chooses what the run covers.
ROLES = """
WITH s AS (SELECT *, sha256(content) AS hash, count(*) OVER (PARTITION BY strlen(content)) AS n_size, count(*) OVER (PARTITION BY sha256(content)) AS n_hash,
  min(rel_path) OVER (PARTITION BY sha256(content)) AS first FROM tree_files WHERE {rows}),
p AS (SELECT *, CASE WHEN n_hash = 1 THEN 'unique' WHEN first = rel_path THEN 'canonical' ELSE 'duplicate' END AS role FROM s)
"""


def _arrived(spark: SparkSession, dst: str, done: flows.Run) -> DataFrame:
    """rel_path and hash of every file at the destination, with the action and check of the run that touched it."""
    below = paths.relative(F.col("dest_path"), dst).alias("rel_path")
    there = scan.hash_files(scan.walk(spark, dst)).select(paths.relative(F.col("path"), dst).alias("rel_path"), "hash")
    acted = done.outcomes.select(below, "action")
    return there.join(acted, "rel_path", "full").join(done.checks.select(below, "status"), "rel_path", "left").select("rel_path", "hash", "action", "status")


@query("copy_run", ROLES.format(rows="true") + "SELECT rel_path, hash, CASE WHEN role = 'duplicate' THEN 'linked' ELSE 'copied' END AS action, CASE WHEN role <> 'duplicate' AND n_size > 1 THEN 'ok' END AS status FROM p")
def copy_run(spark: SparkSession, d: str) -> DataFrame:
    src, dst = _tree(spark, d), mounted(new_folder(spark, "copy"))
    return _arrived(spark, dst, flows.run(spark, src, dst))


CHANGED = "doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 7 = 0"


@query(
    "mirror_run",
    ROLES.format(rows=CHANGED) + f"""SELECT rel_path, hash, CASE WHEN role = 'duplicate' THEN 'linked' ELSE 'copied' END AS action, CASE WHEN role <> 'duplicate' AND n_size > 1 THEN 'ok' END AS status FROM p
    UNION ALL SELECT rel_path, sha256(content), NULL, NULL FROM tree_files WHERE NOT ({CHANGED})
    UNION ALL SELECT rel_path, NULL, 'deleted', NULL FROM old_tree WHERE rel_path LIKE 'stale/%'""",
)
def mirror_run(spark: SparkSession, d: str) -> DataFrame:
    src, dst = _tree(spark, d), _tree(spark, d, "old_tree")
    return _arrived(spark, dst, flows.run(spark, src, dst, incremental=True, delete=True))


#: The copies of a run in batches of 1 MiB, a file counting 64 KiB beside its bytes: the first two batches are what a broken-off run commits.
FIRST = """, o AS (SELECT rel_path, strlen(content) + 65536 AS weight, row_number() OVER (ORDER BY rel_path) AS i FROM p WHERE role <> 'duplicate'),
b AS (SELECT i, rel_path, 0 AS batch, weight AS run FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.rel_path, CASE WHEN b.run >= 1048576 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.run >= 1048576 THEN o.weight ELSE b.run + o.weight END FROM b JOIN o ON o.i = b.i + 1)
"""


@query(
    "resumed_run",
    ROLES.format(rows="true").replace("WITH", "WITH RECURSIVE") + FIRST + """SELECT rel_path, CASE WHEN role = 'duplicate' THEN 'linked' WHEN n_size > 1 THEN 'verified' ELSE 'copied' END AS status,
    CASE WHEN batch < 2 THEN 'skipped' WHEN role = 'duplicate' THEN 'linked' ELSE 'copied' END AS action FROM p LEFT JOIN b USING (rel_path)""",
)
def resumed_run(spark: SparkSession, d: str) -> DataFrame:
    """A run that ends after two commits, and the run that goes on from there."""
    src, dst, record = _tree(spark, d), mounted(new_folder(spark, "resumed")), new_folder(spark, "manifest")
    flows.run(spark, src, dst, record=record, commit_bytes=1 << 20, most_commits=2)
    log = flows.run(spark, src, dst, record=record, keep_record=True).log().select(paths.relative(F.col("path"), src).alias("rel_path"), "action")
    return manifest.newest(spark, record).select("rel_path", "status").join(log, "rel_path", "full")

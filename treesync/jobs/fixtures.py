"""Inventories derived from the given tables, for Spark and for DuckDB.

``SUFFIX`` and the arithmetic on ids are only there to make files differ: some change, some vanish, some repeat.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from treesync.functions.shared import mounted

NAME = "concat({root}, source, '/', lang, '/', cast(doc_id AS string), CASE WHEN doc_id % 10 = 3 THEN '.log' WHEN doc_id % 10 = 7 THEN '.tmp' ELSE '.txt' END)"
VIEWS = {
    "src_files": f"""
SELECT doc_id, {NAME.format(root="'/src/'")} AS path, cast(octet_length(text) AS bigint) AS size, 'sha256' AS hash_algo, sha2(text, 256) AS hash, text AS content,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (doc_id * 7919) % 10007 * 4096 END AS physical_offset, CASE WHEN doc_id % 5 = 0 THEN 33261 ELSE 33188 END AS permissions,
  CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 1700000000 + doc_id * 60 END AS modified_epoch, source AS shard FROM documents""",
    "dst_files": f"""
SELECT {NAME.format(root="'/dst/'")} AS path, cast(octet_length(text) AS bigint) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size,
  CASE WHEN doc_id % 23 = 0 THEN sha2(translate(text, 'ae', 'ea'), 256) ELSE sha2(text, 256) END AS hash, 1700000000 + doc_id * 60 + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS modified_epoch
FROM documents WHERE doc_id % 11 <> 0
UNION ALL SELECT concat('/dst/stale/', cast(doc_id AS string), '.txt'), cast(octet_length(text) AS bigint), sha2(text, 256), 1700000000 FROM documents WHERE doc_id % 17 = 0""",
    "hash_cache": """
SELECT path, size, coalesce(modified_epoch, 0) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, hash, 'sha256' AS algo, 2 AS seq FROM src_files WHERE doc_id % 3 <> 0
UNION ALL SELECT path, size + 7, 1600000000, sha2(path, 256), 'sha256', 1 FROM src_files WHERE doc_id % 6 = 1""",
    "manifest": """
SELECT substring(path, 6) AS rel_path, size + CASE WHEN doc_id % 28 = 5 THEN 1 ELSE 0 END AS size,
  CASE WHEN doc_id % 8 = 0 THEN NULL WHEN doc_id % 12 = 1 THEN sha2(path, 256) ELSE hash END AS source_hash,
  CASE doc_id % 3 WHEN 0 THEN 'copied' WHEN 1 THEN 'verified' ELSE 'linked' END AS status FROM src_files WHERE doc_id % 4 IN (0, 1)""",
    "run_log": """
SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'view' THEN 'copied' WHEN 'click' THEN 'linked' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'progress' END AS action,
  concat('/src/', cast(user_id AS string), '/', cast(event_id AS string)) AS path, cast(floor(value * 100) AS bigint) AS size FROM events""",
    "timed_log": """
SELECT user_id AS run, event_id AS seq, concat(replace(cast(ts AS string), ' ', 'T'), 'Z') AS timestamp, to_timestamp(concat(cast(ts AS string), 'Z')) AS at,
  CASE event_type WHEN 'view' THEN 'copied' WHEN 'click' THEN 'linked' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'error' ELSE 'progress' END AS action,
  cast(floor(value * 100) AS bigint) AS size FROM events""",
    "listing": """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat(hash, ' *', substring(path, 6)) WHEN doc_id % 10 = 1 THEN concat(substring(hash, 1, 63), '  ', path) WHEN doc_id % 10 = 2 THEN ''
  WHEN doc_id % 10 = 3 THEN concat('zz', substring(hash, 3, 62), '  ', path) ELSE concat(hash, '  ', substring(path, 6)) END AS value FROM src_files""",
    "volumes": """
SELECT DISTINCT concat('/src/', source) AS volume, CASE WHEN source = 'src3' THEN NULL ELSE cast(length(source) * 10000 AS bigint) END AS available FROM documents""",
    "tree_files": """
SELECT doc_id, concat(source, '/', lang, '/', CASE WHEN doc_id % 29 = 0 THEN '.' WHEN doc_id % 31 = 0 THEN '_' ELSE '' END, cast(doc_id AS string), '.txt') AS rel_path,
  CASE WHEN doc_id % 37 = 0 THEN '' ELSE text END AS content, CASE WHEN doc_id % 5 = 0 THEN 33261 ELSE 33188 END AS permissions, 1700000000 + doc_id * 60 AS modified_epoch FROM documents""",
    "old_tree": """
SELECT doc_id, rel_path, CASE WHEN doc_id % 13 = 0 THEN concat(content, 'x') ELSE content END AS content, permissions, modified_epoch + CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS modified_epoch
FROM tree_files WHERE doc_id % 11 <> 0
UNION ALL SELECT doc_id, concat('stale/', cast(doc_id AS string), '.txt'), content, permissions, modified_epoch FROM tree_files WHERE doc_id % 17 = 0""",
    "src_objects": """
SELECT concat('/lake/', cast(l_orderkey AS string), '/', cast(l_linenumber AS string), '/', cast(l_partkey AS string), '-', cast(l_suppkey AS string)) AS path,
  cast(floor(l_quantity * 1024) AS bigint) AS size, 'sha256' AS hash_algo, sha2(concat_ws('|', cast(l_partkey AS string), cast(l_suppkey AS string)), 256) AS hash, l_orderkey * 4096 AS physical_offset,
  unix_timestamp(cast(l_shipdate AS timestamp)) AS modified_epoch FROM lineitem""",
}
NEEDS = {"hash_cache": ["src_files"], "manifest": ["src_files"], "listing": ["src_files"], "old_tree": ["tree_files"]}
TABLE = {"src_files": "documents", "dst_files": "documents", "run_log": "events", "timed_log": "events", "volumes": "documents", "tree_files": "documents", "src_objects": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    below = [(n, view(spark, sf_dir, n)) for n in NEEDS.get(name, [])] or [(TABLE[name], spark.read.parquet(f"{sf_dir}/{TABLE[name]}.parquet"))]
    return spark.sql(VIEWS[name].replace(f"FROM {below[0][0]}", "FROM {below}"), below=below[0][1])


def write_tree(files: DataFrame, root: str) -> str:
    """Write ``files(rel_path, content, permissions, modified_epoch)`` as files below ``root``, on a file system that all executors mount; the plain path of the root."""
    top = mounted(root)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = os.path.join(top, row.rel_path)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{os.urandom(6).hex()}", "wb") as out:
                    out.write(row.content.encode())
                os.chmod(out.name, row.permissions & 0o777)
                os.utime(out.name, (row.modified_epoch, row.modified_epoch))
                os.replace(out.name, path)
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("rel_path", "content", "permissions", "modified_epoch").mapInPandas(put, "n long").agg({"n": "sum"}).collect()
    return top


def duck(sql: str) -> str:
    """The spelling of DuckDB."""
    import re

    sql = re.sub(r"octet_length\(", "strlen(", sql).replace("unix_timestamp(cast(l_shipdate AS timestamp))", "cast(floor(epoch(l_shipdate)) AS bigint)")
    while m := re.search(r"sha2\(", sql):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end() : i - 1]
        sql = sql[: m.start()] + "sha256(" + inner[: inner.rindex(",")] + ")" + sql[i:]
    return sql


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names."""
    import re

    used: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in used:
            used.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    ctes = [f"{n} AS MATERIALIZED ({duck(VIEWS[n])})" for n in used]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE") if recursive else len("WITH") :]
        ctes, body = [*ctes, body.strip()], ""
        return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body

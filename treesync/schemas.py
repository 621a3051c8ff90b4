"""Row schemas of inventories, plans, manifests and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "path string, size long, hash_algo string, hash string, physical_offset long, permissions int, modified_epoch long"
MANIFEST = "rel_path string, size long, source_hash string, status string, updated_at timestamp"
MANIFEST_DOC = (
    "version int, source_root string, dest_root string, hash_algorithm string, started_at timestamp, updated_at timestamp, "
    "files map<string, struct<relative_path string, size long, source_hash string, status string, updated_at timestamp>>"
)
RUN_LOG = (
    "run long, seq long, timestamp string, action string, path string, size long, method string, link_target string, error string, phase string, "
    "progress struct<files_done long, files_total long, bytes_done long, bytes_total long>"
)
#: Stands for an unknown physical offset in orders: after all known ones.
LAST = 9223372036854775807


def with_file_defaults(df: DataFrame) -> DataFrame:
    """Add the FILES columns that are missing: null, and 0 for permissions."""
    for field in FILES.split(", "):
        name, kind = field.split(" ")
        if name not in df.columns:
            df = df.withColumn(name, (F.lit(0) if name == "permissions" else F.lit(None)).cast(kind))
    return df

"""Path arithmetic on columns, by components, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; a path that isn't under it (by whole components) stays as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def to_dest(path: Column, src_root: str, dst_root: str) -> Column:
    """Where a source path lies at the destination; an absolute path outside the source root stays itself."""
    rel = relative(path, src_root)
    return F.when(rel.startswith("/"), rel).otherwise(F.concat(F.lit(dst_root.rstrip("/") + "/"), rel))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The parent; '/' for a file of the root, '' for a bare name."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")), "").when(cut == "", "/").otherwise(cut)


def link_target(target: Column, from_dir: Column) -> Column:
    """``target`` as seen from a directory: one '..' for each component that isn't shared, then the rest."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  a value that is computed once

    def climb(p: Column) -> Column:
        first = F.array_position(F.zip_with(p["t"], p["d"], lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        common = F.when(first == 0, F.least(F.size(p["t"]), F.size(p["d"]))).otherwise(first - 1).cast("int")
        return let(common, lambda n: F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(p["d"]) - n), F.slice(p["t"], n + 1, F.size(p["t"]))), "/"))

    return let(F.struct(F.split(target, "/").alias("t"), F.split(from_dir, "/").alias("d")), climb)

"""Copies and links on a file system that all executors mount."""

from __future__ import annotations

import os
import shutil
import stat
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTCOME = "path string, dest_path string, size long, action string, method string, error string"


def _into(dest: str, make: Callable[[str], str]) -> str:
    """Make a file beside ``dest`` and rename it: a task that runs again, or twice at once, leaves a whole file."""
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    part = f"{dest}.{os.urandom(6).hex()}.part"
    try:
        method = make(part)
        os.replace(part, dest)
        return method
    finally:
        if os.path.lexists(part):
            os.unlink(part)


def _outcomes(rows: DataFrame, action: str, one: Callable[[pd.Series], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((row.path, row.dest_path, row.size, action, one(row), None))
                except OSError as e:
                    out.append((row.path, row.dest_path, row.size, "error", None, str(e)))
            yield pd.DataFrame(out, columns=["path", "dest_path", "size", "action", "method", "error"]).astype({"size": "Int64"})

    n = rows.sparkSession.sparkContext.defaultParallelism * 4
    return rows.repartition(n, "path").mapInPandas(run, OUTCOME)


def copy(planned: DataFrame) -> DataFrame:
    """Copy ``path`` to ``dest_path`` with times and permission bits; one outcome a row, failures as action ``error``."""

    def one(row) -> str:
        def make(part: str) -> str:
            shutil.copyfile(row.path, part)
            meta = os.stat(row.path)
            os.chmod(part, stat.S_IMODE(meta.st_mode))
            os.utime(part, ns=(meta.st_atime_ns, meta.st_mtime_ns))
            return "copied"

        return _into(row.dest_path, make)

    return _outcomes(planned.select("path", "dest_path", "size"), "copied", one)


def link(links: DataFrame, symlinks: bool = True) -> DataFrame:
    """Make ``dest_path`` a hard link to ``canonical_dest``; across volumes a relative symbolic link, or a copy without ``symlinks``.

    An outcome's method is ``linked``, ``symlinked`` or ``fallback_copied``. A canonical file that isn't there is a failure.
    """

    def one(row) -> str:
        def make(part: str) -> str:
            os.stat(row.canonical_dest)
            try:
                os.link(row.canonical_dest, part)
                return "linked"
            except OSError:
                if symlinks:
                    os.symlink(row.link_target, part)
                    return "symlinked"
                shutil.copy2(row.canonical_dest, part)
                return "fallback_copied"

        # Renaming a hard link onto another link of the same file does nothing, so the old name goes first.
        if os.path.exists(row.dest_path) and os.path.samefile(row.dest_path, row.canonical_dest):
            return "linked"
        return _into(row.dest_path, make)

    return _outcomes(links.select("path", "dest_path", "size", "canonical_dest", "link_target"), "linked", one)


def delete(files: DataFrame) -> DataFrame:
    """Remove ``path``; a file that is gone already counts as removed, so a repeated task does no harm."""

    def one(row) -> str:
        try:
            os.unlink(row.path)
        except FileNotFoundError:
            pass
        return "deleted"

    return _outcomes(files.selectExpr("path", "path AS dest_path", "size"), "deleted", one)

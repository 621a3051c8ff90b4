"""Exclusion by glob patterns, compiled to one regular expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesync.functions.paths import relative


def compile_glob(pattern: str) -> str:
    """A pattern as a regular expression: '*' and '?' cross '/', '[a-z]' and '[!a]' are classes, '**' stands for whole components only."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            if pattern.startswith("***", i) or (i and pattern[i - 1] != "/"):
                raise ValueError(f"'**' must be a whole component: {pattern}")
            if pattern.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif i + 2 == len(pattern):
                out, i = out + ".*", i + 2
            else:
                raise ValueError(f"'**' must be a whole component: {pattern}")
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern.startswith("[!", i) else 2))
            if end < 0:
                raise ValueError(f"a class isn't closed: {pattern}")
            inside = pattern[i + 1 : end]
            negated, inside = inside.startswith("!"), inside.removeprefix("!")
            out, i = out + "[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", inside) + "]", end + 1
        else:
            out, i = out + {"*": ".*", "?": "."}.get(c, re.escape(c)), i + 1
    return out


def excluded(rel: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches the relative path, its name, or those of a directory above it (which prunes what lies below)."""
    if not patterns:
        return F.lit(False)
    whole = "(?s)^(?:" + "|".join(map(compile_glob, patterns)) + ")$"
    parts = F.split(rel, "/")
    prefix = F.exists(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/").rlike(whole))
    return prefix | F.exists(parts, lambda c: c.rlike(whole))


def exclude(files: DataFrame, root: str, patterns: list[str]) -> DataFrame:
    return files.where(~excluded(relative(F.col("path"), root), patterns))


def skip_prefix(files: DataFrame, root: str, prefix: str) -> DataFrame:
    """Drop files below the root whose name, or a directory of whose path, starts with the metadata prefix."""
    return files.where(~F.exists(F.split(relative(F.col("path"), root), "/"), lambda c: c.startswith(prefix)))

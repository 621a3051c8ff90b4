"""Hash listings made by other tools, as text or JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesync.functions.hashing import LENGTHS, from_hex
from treesync.functions.paths import relative


def _parsed(lines: DataFrame, path: Column, text: Column, algorithm: str) -> DataFrame:
    digest = from_hex(text)
    return lines.select(path.alias("rel_path"), F.lit(algorithm).alias("hash_algo"), digest.alias("hash")).where(
        F.coalesce((F.octet_length("hash") == LENGTHS[algorithm]) & (F.col("rel_path") != ""), F.lit(False))
    )


def _split(line: Column, *separators: str) -> tuple[Column, Column]:
    """(before, after) the first separator that occurs, both trimmed; null without any."""
    before = after = F.lit(None).cast("string")
    for s in reversed(separators):
        at = F.instr(line, s)
        before = F.when(at > 0, F.trim(F.substring(line, F.lit(1), at - 1))).otherwise(before)
        after = F.when(at > 0, F.trim(F.substring(line, at + len(s), F.length(line)))).otherwise(after)
    return before, after


def parse_sha256(lines: DataFrame) -> DataFrame:
    """``lines(value)`` of digest and path, separated by two spaces or by ' *'; other lines are dropped."""
    before, after = _split(F.trim("value"), "  ", " *")
    return _parsed(lines, after, before, "sha256")


def parse_xxhsum(lines: DataFrame) -> DataFrame:
    before, after = _split(F.trim("value"), "  ")
    return _parsed(lines, after, before, "xxhash128")


def parse_json(lines: DataFrame, algorithm: str) -> DataFrame:
    """JSON lines of {"path", "hash"}; blank and invalid lines and digests of another length are dropped."""
    row = F.from_json("value", "path string, hash string")
    return _parsed(lines, row["path"], row["hash"], algorithm)


def merge(*batches: DataFrame) -> DataFrame:
    """All listings; for a path in several of them the last wins."""
    rows = reduce(DataFrame.unionByName, [b.withColumn("__batch", F.lit(i)) for i, b in enumerate(batches)])
    last = rows.groupBy("rel_path").agg(F.max_by(F.struct("hash_algo", "hash"), "__batch").alias("last"))
    return last.select("rel_path", "last.hash_algo", "last.hash")


def attach(files: DataFrame, listing: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(files with the listing's digests, files without one). Paths of either side may be absolute or relative to the root."""
    keyed = files.drop("hash_algo", "hash").withColumn("rel_path", relative(F.col("path"), root))
    known = listing.select(relative(F.col("rel_path"), root).alias("rel_path"), "hash_algo", "hash").dropDuplicates(["rel_path"])
    return keyed.join(known, "rel_path", "left"), keyed.join(known, "rel_path", "left_anti")

"""Content digests and their text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Bytes of each digest.
LENGTHS = {"xxhash128": 16, "blake3": 32, "sha256": 32}


@F.pandas_udf(BinaryType())
def _xxh3(content: pd.Series) -> pd.Series:
    import xxhash

    return content.map(lambda x: None if x is None else xxhash.xxh3_128_digest(x))


@F.pandas_udf(BinaryType())
def _blake3(content: pd.Series) -> pd.Series:
    from blake3 import blake3

    return content.map(lambda x: None if x is None else blake3(x).digest())


def digest(content: Column, algorithm="sha256") -> Column:
    """Digest of a binary column; ``algorithm`` is a name of ``LENGTHS`` or the caller's own Arrow UDF of binary."""
    if callable(algorithm):
        return algorithm(content)
    if algorithm == "sha256":
        return F.unhex(F.sha2(content, 256))
    if algorithm == "xxhash128":
        return _xxh3(content)
    if algorithm == "blake3":
        try:
            import blake3  # noqa: F401
        except ImportError as e:
            raise ValueError("blake3 needs the blake3 package") from e
        return _blake3(content)
    raise ValueError(f"unknown algorithm {algorithm}")


def to_hex(digest_bytes: Column) -> Column:
    return F.lower(F.hex(digest_bytes))


def from_hex(text: Column) -> Column:
    """Bytes of an even number of hexadecimal digits, else null."""
    return F.when(text.rlike("^(?:[0-9a-fA-F]{2})*+$"), F.unhex(text))


def valid(algo: Column, digest_bytes: Column) -> Column:
    """Whether a digest has its algorithm's length; false for unknown algorithms and nulls."""
    tests = [(algo == a) & (F.octet_length(digest_bytes) == n) for a, n in LENGTHS.items()]
    return F.coalesce(tests[0] | tests[1] | tests[2], F.lit(False))


def stats(files: DataFrame) -> DataFrame:
    """files_hashed, bytes_hashed, cache_hits, errors of ``files(size, hash, cache_hit, error)``; cached rows aren't hashed."""
    done = F.col("hash").isNotNull() & ~F.col("cache_hit")
    return files.agg(
        F.count_if(done).alias("files_hashed"),
        F.coalesce(F.sum(F.when(done, F.col("size"))), F.lit(0)).alias("bytes_hashed"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )

"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows partition p sends to shard s is drawn from the multivariate hypergeometric law given all partition counts:
the matrix is drawn by halving the range of partitions, so a task draws its own row, one number a shard, in
log2(partitions) steps from seeds alone, and nothing but the counts is broadcast. Inside a partition the labels are
permuted. A shard is permuted again by random keys: ranges of keys are its bins, whose counts, summed up, say where the
slots of each begin.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treesync.llm.common import bounded, small_batches, stage, table, with_row_address

#: Below this size of population numpy samples; from it on its factorials lose precision, and ``hypergeometric`` rejects by ratios.
NUMPY_BELOW = 10**9


def bin_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes by shard, then bin: shards differ by one row at most, and so do the bins of a shard."""
    size = lambda n, k: n // k + (np.arange(k) < n % k)
    return np.concatenate([size(int(n), per_shard) for n in size(rows, shards)]).astype(np.int64)


def log_factorials(a: int, b: int) -> float:
    """ln(a!) - ln(b!), without the two being computed: for neighbours at 10^12 that would cost all digits."""
    if min(a, b) < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    d = a - b
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (b + 0.5) * math.log1p(d / b) + d * (math.log(a) - 1) + series(a) - series(b)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn without replacement from good + bad are good, for populations of any size.

    Ratio of uniforms with rejection (Stadlober, 1990): what is accepted has the hypergeometric law, with probabilities
    taken as ratios to that of the mode.
    """
    total = good + bad
    if total < NUMPY_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    if good > bad:
        return n - hypergeometric(rng, bad, good, n)
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    high, mode = min(good, n), (n + 1) * (good + 1) // (total + 2)
    if not high:
        return 0
    mean = n * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if not 0 <= k <= high:
            continue
        against = log_factorials(k, mode) + log_factorials(good - k, good - mode) + log_factorials(n - k, n - mode) + log_factorials(bad - n + k, bad - n + mode)
        if 2 * math.log(u) <= -against:
            return k


def _draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn without replacement, fall into each bin: bin by bin, given those before."""
    out, total, i = np.zeros_like(sizes), int(sizes.sum()), 0
    while total >= NUMPY_BELOW:
        size = int(sizes[i])
        out[i] = hypergeometric(rng, size, total - size, n)
        n, total, i = n - int(out[i]), total - size, i + 1
    if i < len(sizes):
        out[i:] = rng.multivariate_hypergeometric(sizes[i:], n, method="marginals")
    return out


def matrix_row(p: int, before: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the matrix; ``before[i]`` rows lie in the partitions before i."""
    low, high = 0, len(before) - 1
    while high - low > 1:
        mid = (low + high) // 2
        left = _draw(np.random.default_rng([seed, low, high]), sizes, int(before[mid] - before[low]))
        low, high, sizes = (low, mid, left) if p < mid else (mid, high, sizes - left)
    return sizes


def uniform_shuffle(df: DataFrame, shards: int = 16, seed: int = 7, rows_per_bin: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), all columns and rows kept.

    Every assignment with the exact shard sizes is equally likely; sizes differ by one row at most. Values are not
    looked at: nulls, ties, very long texts and repeated rows are rows like any other. An empty table stays empty. Columns of ``df`` named
    shard or slot are replaced. About ``rows_per_bin`` rows are sorted at once.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop("shard", "slot")
    rows = stage(with_row_address(df, "__block", "__pos"), "shuffle")
    counts = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()}  # one number per partition
    blocks = sorted(counts)
    before = np.concatenate([[0], np.cumsum([counts[b] for b in blocks])]).astype(np.int64)
    n = int(before[-1])
    shared = spark.sparkContext.broadcast((np.asarray(blocks), before, bin_sizes(n, shards, 1)))
    labels: dict[int, np.ndarray] = {}

    @F.pandas_udf("int")
    def place(block: pd.Series, pos: pd.Series) -> pd.Series:
        numbers, cum, sizes = shared.value
        out = np.empty(len(block), np.int32)
        for b in np.unique(block.to_numpy()):
            if b not in labels:
                labels.clear()
                p = int(np.searchsorted(numbers, b))
                mine = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(p, cum, sizes, seed))
                labels[b] = np.random.default_rng([seed, p]).permutation(mine)
            at = (block == b).to_numpy()
            out[at] = labels[b][pos.to_numpy()[at]]
        return pd.Series(out)

    bits = max(2, math.ceil(math.log2(max(1, n / (shards * rows_per_bin)))))
    key = F.xxhash64(F.lit(seed), "__block", "__pos")
    dealt = lambda df: df.withColumns({"shard": place("__block", "__pos"), "__bin": F.shiftrightunsigned(key, 64 - bits).cast("long")})
    filled = dealt(rows.select("__block", "__pos")).groupBy("shard", "__bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
    first = stage(filled.select("shard", "__bin", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("__first")), "bins")
    inside = Window.partitionBy("shard", "__bin").orderBy(key, "__block", "__pos")
    numbered = dealt(rows).withColumn("__in", F.row_number().over(inside) - 1)
    out = numbered.join(bounded(first), ["shard", "__bin"]).withColumn("slot", (F.col("__first") + F.col("__in")).cast("long"))
    return out.select(*df.columns, "shard", "slot")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law ``rows``. The method keeps no groups together, and has no grown shard."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return uniform_shuffle(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Audit of how filters interact: what each removes in every order, by a subset-zeta transform of counts of failure masks.

Every document fails a set of filters, its mask. Counts of masks by part, 32 numbers each however many documents, say all:
the zeta transform turns them into the survivors of every subset of filters, and each step of each order is the difference
between the survivors of two neighbouring subsets. The same holds for the labelled documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, stage, table

#: The filters, a bit of the mask each, in this order.
FILTERS = "ABCDE"
#: Filter E, which needs the whole table; the others look at one text.
REPEATED = 1 << FILTERS.index("E")
MARKS = b"#$%&*|"


def text_mask(raw: bytes, least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5) -> int:
    """Bits of the filters A to D that the UTF-8 text fails."""
    words = raw.split()  # of bytes: at space and tab to carriage return
    octets = np.frombuffer(raw, np.uint8)
    capitals = np.count_nonzero((octets >= 65) & (octets <= 90))
    points = np.count_nonzero((octets & 0xC0) != 0x80)
    return (
        (len(words) < least_words) + 2 * (100 * len(set(words)) < least_distinct * len(words)) + 4 * (100 * capitals > most_capitals * points)
        + 8 * (len(raw.translate(None, MARKS)) < len(raw))
    )


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = np.empty(batch.num_rows, np.int32), []
        for i, text in enumerate(batch.column(2)):
            raw = text.as_buffer().to_pybytes()
            masks[i] = text_mask(raw)
            digests.append(hashlib.sha256(raw).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail exactly the filters of mask, and how many of them are labelled quality = 1 and toxic = 1.

    Texts are read once; from there on rows are an id, a part, a mask and a digest. A text's first id is a minimum that is
    taken before the shuffle, and ids then meet (text, first id), so many copies of one text are no hot group.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stage(slim.mapInArrow(_masks, "doc_id long, part string, mask int, digest binary"), "filter-masks")
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    judged = (
        known.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
        .select("part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + REPEATED).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    )
    nameless = rows.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return judged.unionByName(nameless).groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """counts[..., mask] of documents that fail exactly mask -> [..., subset] of those that no filter of the subset removes.

    The zeta transform sums, for each set, the counts of all its subsets; a subset of filters spares what fails only the others.
    """
    out, full = counts.copy(), counts.shape[-1] - 1
    for bit in range(full.bit_length()):
        on = np.flatnonzero(np.arange(full + 1) >> bit & 1)
        out[..., on] += out[..., on ^ (1 << bit)]
    return out[..., full - np.arange(full + 1)]


def _orders(filters: str):
    """Of all steps of all orders: order, step, its filter, subset before, subset after."""
    rows = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(filters[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    return rows


def _audit(filters: str):
    k, orders = len(filters), _orders(filters)
    names, steps, which, before, after = (np.array(x) for x in zip(*orders, strict=True))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 1 << k), np.int64)
        counts[:, group["mask"]] = group[["n", "good", "toxic"]].to_numpy().T
        left, good, toxic = survivors(counts)
        alone = [1 << f for f in range(k)]
        fails = left[0] - left[alone]
        unique = left[[(1 << k) - 1 - b for b in alone]] - left[-1]
        shapley = [sum(factorial(s.bit_count()) * factorial(k - 1 - s.bit_count()) * int(left[s] - left[s | b]) for s in range(1 << k) if not s & b) for b in alone]
        removed = left[before] - left[after]
        return pd.DataFrame({
            "part": group["part"].iloc[0], "filter_order": names, "step": steps.astype(np.int32), "kept": left[after], "removed": removed, "redundant": fails[which] - removed,
            "unique_fails": unique[which], "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after], "shapley": np.array(shapley, np.int64)[which],
        })

    return run


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the five filters, for each part (source) of ``docs(doc_id, text, source, ...)``.

    A document fails A with under 50 words, B if 100 * distinct words < 65 * words, C if over 5 % of its code points are
    A to Z, D if it has one of ``#$%&*|``, E if a smaller doc_id has the identical text. Columns: part, filter_order, step, kept,
    removed, redundant (fails, but removed earlier), unique_fails, good_lost, toxic_lost, shapley (removed by the filter, summed over
    all orders; divide by their number for its Shapley value).

    Null text counts as empty, a null source is the part ''. Rows with a null doc_id never fail E, make none fail it and have
    no label. Repeated rows of one doc_id and text count each, and neither fails E through the other. Of several label rows
    of a doc_id, any that says 1 counts. Texts of any length pass row by row. Other columns are not read. An empty table gives
    no rows. Texts are compared by SHA-256.
    """
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return mask_counts(docs, labels).groupBy("part").applyInPandas(_audit(FILTERS), schema)  # 32 rows a part at most


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; odd rows as in ``filter_audit``."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
  'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS s
  FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT doc_id, part, good, toxic, CASE WHEN s.A THEN 'A' ELSE '' END || CASE WHEN s.B THEN 'B' ELSE '' END || CASE WHEN s.C THEN 'C' ELSE '' END || CASE WHEN s.D THEN 'D' ELSE '' END || CASE WHEN s.E THEN 'E' ELSE '' END AS fails FROM m),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substring(filter_order, step, 1) AS filter, substring(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT *, contains(fails, filter) AS failing, earlier <> '' AND regexp_matches(fails, '[' || earlier || '_]') AS gone FROM s, c),
t AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = filter THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, filter) AS bigint) AS shapley FROM t
"""

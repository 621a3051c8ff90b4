"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every scan partition (block) keeps, per row, the SHA-256 of the normalised text and a short fingerprint of it.
2. A block sends the sorted *distinct* fingerprints of each owner (a range of the fingerprint space) as one
   Golomb-Rice coded message. Fingerprints that repeat inside the block it knows by itself, so a text that makes up a
   third of the corpus costs one code per block.
3. An owner merges its messages and answers each with a bitmap: bit i says that another block sent code i too.
4. A block marks its suspects. Only suspects' texts are read again and grouped by their bytes.

Fingerprints are log2(rows) + 10 bits long: about one row in a thousand becomes a suspect by chance, which the
comparison of the bytes undoes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import bounded, join_classes, small_batches, stage, table, with_row_address

#: The code points that normalisation deletes: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A list of suspect fingerprints is broadcast up to so many rows (8 bytes each), and beyond that joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows whose codes one owner decodes at once.
OWNER_ROWS = 5_000_000
LAST = (1 << 63) - 1


def golomb_encode(values: np.ndarray, low: int, k: int) -> bytes:
    """Sorted distinct integers >= low as Golomb-Rice codes (divisor 2**k) of their gaps: all unary parts, then all remainders."""
    gaps = np.diff(values, prepend=low).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, ::-1]) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, rest])).tobytes()


def golomb_decode(data: bytes, count: int, low: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    ends = np.flatnonzero(bits)[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1 : ends[-1] + 1 + count * k].reshape(count, k).astype(np.int64)
    weights = (np.int64(1) << np.arange(k, dtype=np.int64))[::-1]
    return low + np.cumsum((quotients.astype(np.int64) << k) + rest @ weights)


def _spans(values: np.ndarray, owners: int, bits: int) -> Iterator[tuple[int, int, int, int]]:
    """(owner, first possible value, start, end) of the sorted values."""
    lows = [-(-(o << bits) // owners) for o in range(owners + 1)]
    cuts = np.searchsorted(values, np.asarray(lows))
    for o in np.flatnonzero(np.diff(cuts)):
        yield int(o), lows[o], int(cuts[o]), int(cuts[o + 1])


def _sender(owners: int, bits: int):
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        values, out = np.unique(rows["fp"].to_numpy()), []
        for owner, low, start, end in _spans(values, owners, bits):
            n = end - start
            k = max(0, int(math.log2(max(1.0, math.log(2) * (1 << bits) / owners / n))))
            out.append((owner, rows["block"].iloc[0], n, k, golomb_encode(values[start:end], low, k)))
        return pd.DataFrame(out, columns=["owner", "block", "n", "k", "codes"])

    return send


def _owner(owners: int, bits: int):
    def answer(messages: pd.DataFrame) -> pd.DataFrame:
        low = -(-(int(messages["owner"].iloc[0]) << bits) // owners)
        sent = [golomb_decode(c, n, low, k) for c, n, k in zip(messages["codes"], messages["n"], messages["k"], strict=True)]
        values, times = np.unique(np.concatenate(sent), return_counts=True)
        shared = values[times > 1]
        bitmaps = [np.packbits(np.isin(s, shared)).tobytes() for s in sent]
        return pd.DataFrame({"owner": messages["owner"], "block": messages["block"], "bitmap": bitmaps})

    return answer


def _marker(owners: int, bits: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        values, back, times = np.unique(rows["fp"].to_numpy(), return_inverse=True, return_counts=True)
        suspect, bitmaps = times > 1, dict(zip(answers["owner"], answers["bitmap"], strict=True))
        for owner, _, start, end in _spans(values, owners, bits):
            suspect[start:end] |= np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8))[: end - start].astype(bool)
        return rows.assign(suspect=suspect[back])

    return mark


def normalised(text) -> F.Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting blanks (space, tab to carriage return). The row with the most code
    points stays, then the smallest doc_id (null ids come last), then the first of repeated rows. Null text counts as
    empty, and all empty texts are one group; an empty table gives no rows. Other columns are not read. Very long texts
    are single values that Spark digests as they are. Two different texts with one SHA-256 would end the job with an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
    )
    rows = stage(with_row_address(rows), "fingerprints")
    n = rows.count()
    bits = min(52, max(1, math.ceil(math.log2(max(2, n)))) + 10)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // OWNER_ROWS))

    def fingerprint(sha) -> F.Column:
        return F.shiftright(F.conv(F.substring(sha, 1, 15), 16, 10).cast("long"), 60 - bits)

    rows = rows.withColumn("fp", fingerprint(F.col("text_sha256")))
    answers = (
        rows.select("block", "fp").groupBy("block").applyInPandas(_sender(owners, bits), "owner int, block int, n int, k int, codes binary")
        .groupBy("owner").applyInPandas(_owner(owners, bits), "owner int, block int, bitmap binary")
    )
    marked = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _marker(owners, bits), "doc_id long, n_chars long, text_sha256 string, block int, pos long, fp long, suspect boolean"
    )
    marked = stage(marked.drop("fp"), "suspects")
    suspects = marked.where("suspect")
    wanted = stage(suspects.select(fingerprint(F.col("text_sha256")).alias("fp")).distinct(), "suspect-fingerprints")
    wanted = bounded(wanted, BROADCAST_ROWS)

    # Verification: suspects' texts, grouped by their bytes; equal texts meet in the map tasks first.
    texts = docs.select(normalised(F.col("text")).alias("bytes")).withColumn("text_sha256", F.sha2("bytes", 256))
    verified = (
        texts.withColumn("fp", fingerprint(F.col("text_sha256"))).join(wanted, "fp", "left_semi")
        .groupBy("bytes").agg(F.first("text_sha256").alias("text_sha256"), F.count("*").alias("group_size"))
        .groupBy("text_sha256").agg(F.count("*").alias("texts"), F.first("group_size").alias("group_size"))
        .select("text_sha256", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256"))).alias("group_size"))
        .where("group_size > 1")
    )
    order = F.struct((-F.col("n_chars")).alias("longest"), F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("doc_id").isNull().alias("null_id"), "block", "pos", "doc_id")
    winners = suspects.groupBy("text_sha256").agg(F.min(order).alias("best"))
    classes = stage(verified.join(winners, "text_sha256").withColumn("weight", F.col("group_size")), "copy-classes")
    return (
        join_classes(marked, classes, ["text_sha256"])
        .select(
            "doc_id",
            F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            (F.col("best").isNull() | ((F.col("block") == F.col("best.block")) & (F.col("pos") == F.col("best.pos")))).alias("kept"),
            "text_sha256",
            "n_chars",
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; columns kept, whatever their names. The text decides, so repeated rows and null ids are handled as there."""
    groups = exact_dedup(docs).where("group_size > 1 and kept").select(F.col("text_sha256").alias("sha"), F.col("keep_id").alias("keep"), F.col("n_chars").alias("longest"), F.col("group_size").alias("weight"))
    groups = stage(groups, "groups")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(normalised(F.col("text")), 256).alias("sha"))
    few = groups.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    rows = rows.join(F.broadcast(groups.drop("weight")), "sha", "left") if few else join_classes(rows, groups, ["sha"])
    best = rows.where(F.col("longest").isNotNull() & F.col("row.doc_id").eqNullSafe(F.col("keep")) & (F.length(F.coalesce("row.text", F.lit(""))) == F.col("longest")))
    return rows.where("longest is null").select("row.*").unionByName(best.dropDuplicates(["sha"]).select("row.*"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; odd rows as in ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256, n_chars
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""

"""Vector codes: each part of an integer vector becomes the number of its nearest codebook entry.

Codebooks, 16 entries a part, are integers that travel by broadcast. A task takes Arrow batches of vectors and computes all
squared distances as |x|^2 - 2 x.c + |c|^2 in exact 64-bit integers; the first of the least wins. Each round, a task adds up the
parts of every entry, the sums of all tasks meet in a grouped shuffle, and one row per codebook component comes back. All is
integer arithmetic, so the result doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import join_classes, stage, table

#: Rows of an Arrow batch.
BATCH = 4096


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """[n, entries] of the squared distances of the rows x to the entries, in exact 64-bit integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors x[n, parts, width] and books[parts, entries, width]: the nearest entry of each part, ties to the lower, and its squared distance."""
    codes, errors = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p, book in enumerate(books):
        d = squares(x[:, p], book)
        codes[:, p] = d.argmin(1)
        errors[:, p] = d[np.arange(len(d)), codes[:, p]]
    return codes, errors


def _cut(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors of a batch as [n, parts, width], filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    return np.pad(flat, ((0, 0), (0, parts * width - flat.shape[1]))).reshape(len(column), parts, width)


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _cut(batch.column(0), parts, width)
            codes, _ = assign(x, books)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], x[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(_cut(batch.column(2), parts, width), books)
            texts = codes.astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(c).hex() for c in texts]), pa.array(errors.sum(1))], ["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def integer_vectors(vectors: DataFrame, scale: int = 4096) -> DataFrame:
    """vec_id, label, v: the rows whose embedding is not null and has neither null nor non-finite components, as integers floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & fine)
    return whole.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale)).alias("v"))


def fit(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> np.ndarray:
    """Codebooks [parts, entries, width] of ``rows(vec_id, v)``, staged vectors of one length: they begin as the vectors of the smallest ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    width = -(-len(first[0]["v"]) // parts)
    books = np.ascontiguousarray(_cut(pa.array([r["v"] for r in first], pa.list_(pa.int64())), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        added = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        merged = added.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in merged.collect():  # a row for each component of the codebooks at most
            books[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of ``rows(vec_id, label, v)``."""
    return rows.select("vec_id", "label", "v").mapInArrow(_codes(books), f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Codes of ``vectors(vec_id, embedding, label, ...)``: vec_id, label, code (two hexadecimal digits a part), error, label_error, codebooks_sha256.

    Rows whose embedding is null or has null or non-finite components are dropped. Components become floor(scale * x). The
    codebooks start from the smallest vec_ids (null ids last, equal ids by their components) and are replaced ``rounds`` times by floored
    means; ties go to the lower entry, and entries that no part is nearest to stay. With fewer vectors than entries there are fewer
    entries. A length that isn't a multiple of ``parts`` is filled up with zeros, and no components at all have code 0 everywhere.
    Lengths that differ, and components so large that squares could leave 64 bits, are errors. label_error is the error over equal labels, null
    ones together; a hot label is summed before the shuffle and comes back by broadcast. Repeated rows count each. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    rows = stage(rows, "integer-vectors")
    seen = rows.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))).alias("large")).first()
    none = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if seen["least"] is None:
        return spark.createDataFrame([], f"vec_id long, label {dict(rows.dtypes)['label']}, {none[13:]}")
    if seen["least"] != seen["most"]:
        raise ValueError(f"vectors have from {seen['least']} to {seen['most']} components")
    if 4 * (seen["most"] + 1) * int(seen["large"] + 1) ** 2 >= 1 << 63:
        raise ValueError(f"components of up to {seen['large']} are too large for exact squares")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH:
        spark.conf.set(key, str(BATCH))
    books = fit(rows, parts, entries, rounds)
    coded = stage(encode(rows, books), "vector-codes").withColumns({"__none": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    labels = stage(coded.groupBy("__none", "__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("weight")), "label-errors")
    return join_classes(coded, labels, ["__none", "__label"], "inner").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings; odd rows as in ``vector_codes``."""
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def sql(rounds: int = 6) -> str:
    """The same for DuckDB, a pair of subqueries for each round."""
    ctes = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x AS double)) AS bigint)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // 8) AS part, (i - 1) % (len(v) // 8) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM k))",
        "b0 AS MATERIALIZED (SELECT part, e AS entry, pos, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 16) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"d{r} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{r} USING (part, pos) GROUP BY ALL)")
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{r} GROUP BY ALL)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT part, entry, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY ALL)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE cast((s - ((s % n) + n) % n) // n AS bigint) END AS c FROM b{r} LEFT JOIN m{r} USING (part, entry, pos))")
    return "WITH " + ",\n".join(ctes) + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(d) AS bigint) AS error FROM a{rounds} GROUP BY vec_id),
g AS (SELECT sha256(string_agg(cast(c AS varchar), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), g"""

"""Language identification by the nearest of several centroids per language.

Texts are unit TF-IDF vectors of hashed character n-grams. Document frequencies are counted over all learning rows. The
learning rows of a bounded sample of each language are clustered by spherical k-means; a text gets the language of the
centroid of highest cosine. It is rejected when that cosine lies far below what learning rows of its length have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, stage, sum_vectors, table
from treesync.llm.ngrams import DIMS, counts, tfidf

UNKNOWN = "und"
#: Texts whose vectors are held at once: 2 MB of them, where a whole Arrow batch has 16 MB.
ROWS = 64


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # least cosine by binary logarithm of the number of n-grams


def held_out(doc_id) -> F.Column:
    """A third of the documents, by the CRC-32 of the id as text, is never learnt from; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learning(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = counts(text)
            if c is not None:
                out[:-1] += c > 0
                out[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["key", "vec"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the hashed n-grams over all rows of ``texts(text)``; one vector reaches the driver."""
    total = np.zeros(DIMS + 1, np.int64)
    for r in sum_vectors(texts.mapInArrow(_df, "key int, vec binary")).collect():
        total = total + np.frombuffer(r["vec"], np.int64)
    return (np.log((1 + total[-1]) / (1 + total[:-1])) + 1).astype(np.float32)


def _vectors(idf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                x, sizes = tfidf(part["text"].tolist(), idf.value)
                on = sizes > 0
                yield pd.DataFrame({"lang": part["lang"][on], "size": sizes[on], "x": [v.tobytes() for v in x[on]]})

    return run


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows by spherical k-means; the first centres are far from each other."""
    centres = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    c = np.stack(centres)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _fit(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]])
        c = cluster(x, k)
        best = (x @ c.T).max(1)
        sizes = np.log2(rows["size"].to_numpy()).astype(int)
        floors = [{"size": int(s), "floor": float(np.quantile(best[sizes == s], 0.01))} for s in np.unique(sizes)]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [v.astype(np.float32).tobytes() for v in c], "floors": [floors] * len(c)})

    return run


def fit(docs: DataFrame, sample: int = 400, clusters: int = 3, margin: float = 0.5) -> Model:
    """Learn from rows of ``docs(doc_id, text, lang)`` that aren't held out and have a language.

    Document frequencies cover all of them; about ``sample`` rows of each language, chosen by a hash of the id, are clustered.
    A text is rejected below ``margin`` times the first percentile of the cosines of learning rows of its size.
    """
    rows = docs.where(learning(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    idf = document_frequencies(rows.select("text"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(F.broadcast(langs.where(F.col("rows") > 0)), "lang").where(share * F.col("rows") < sample)
    vectors = chosen.select("lang", "text").mapInPandas(_vectors(rows.sparkSession.sparkContext.broadcast(idf)), "lang string, size long, x binary")
    fitted = vectors.groupBy("lang").applyInPandas(_fit(clusters), "lang string, centroid binary, floors array<struct<size int, floor double>>").collect()
    fitted.sort(key=lambda r: (r["lang"], r["centroid"]))
    floors = np.full(64, np.nan)
    for r in fitted:
        for f in r["floors"]:
            floors[f["size"]] = np.nanmin([floors[f["size"]], f["floor"] * margin])
    known = np.flatnonzero(~np.isnan(floors))
    if len(known):  # shorter texts than any learnt from have the least floor, longer ones that of the longest
        floors = np.minimum.accumulate(np.where(np.isnan(floors), np.interp(np.arange(64), known, floors[known]), floors)[::-1])[::-1]
        floors[: known[0]] = 0.0
    return Model([r["lang"] for r in fitted], np.array([np.frombuffer(r["centroid"], np.float32) for r in fitted]).reshape(len(fitted), DIMS), idf, floors)


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct<lang, score, rejected>. Only texts go to Python, other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang string, score double, rejected boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m: Model = shared.value
        n = len(texts)
        best, score, sizes = np.zeros(n, int), np.zeros(n), np.zeros(n, np.int64)
        for at in range(0, n, ROWS):
            part = slice(at, at + ROWS)
            x, sizes[part] = tfidf(texts.iloc[part].tolist(), m.idf)
            if m.langs:
                cos = x @ m.centroids.T
                best[part] = cos.argmax(1)
                score[part] = np.clip(cos.max(1), 0, 1)
        if m.langs:
            lang = [m.langs[b] if s else UNKNOWN for b, s in zip(best, sizes, strict=True)]
            no = (sizes == 0) | (score < m.floors[np.log2(np.maximum(sizes, 1)).astype(int)])
        else:
            lang, no = [UNKNOWN] * n, np.ones(n, bool)
        return pd.DataFrame({"lang": lang, "score": np.where(sizes == 0, 0.0, score), "rejected": no})

    return predict.asNondeterministic()  # a filter on the result must not make Spark evaluate it once more


def identify(docs: DataFrame, model: Model, out: str = "language") -> DataFrame:
    """``docs`` with the struct column ``out`` (lang, score, rejected), in one narrow pass; all other columns and rows kept.

    Only ``text`` is looked at, whole. Texts that are null, empty or without letters get ``und``, score 0, and are rejected; so is
    everything if nothing could be learnt. A column named ``out`` is replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    return docs.withColumn(out, predictor(spark, model)(F.col("text").cast("string")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; odd rows as in ``identify``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    small_batches(spark)
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))

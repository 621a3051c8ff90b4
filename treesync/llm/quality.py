"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or nothing (-1) on every document. Expectation maximisation over the counts of
vote patterns of all documents estimates, for each labeller, how it votes on good and on bad documents. The posterior of
each pattern is the soft label of its documents; soft labels train a linear scorer over hashed n-grams and bucketed
text statistics, which scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, sum_vectors, table
from treesync.llm.ngrams import DIMS, counts, tfidf

GOOD, BAD, NOTHING = 1, 0, -1


STATISTICS = ("words", "letters", "symbols", "shouts", "capitals", "varied", "lines", "length", "ended")
LABELLERS = ("symbols", "shouting", "variety", "lines", "letters", "word length", "sentence ends", "capitals")
_SYMBOLS = str.maketrans("", "", "%&$*#|<>{}=~^\\")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]+")
_OTHER = re.compile(r"[\W\d_]+")
_ENDED = tuple(".!?…\"'”»")


def statistics(text: str) -> tuple[float, ...]:
    """What the labellers look at, in the order of ``STATISTICS``."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars = len(words), max(len(text), 1)
    return (
        n,
        len(_OTHER.sub("", text)) / chars,
        (len(text) - len(text.translate(_SYMBOLS))) / chars,
        text.count("!") / max(n, 1),
        sum(map(len, _UPPER.findall(text))) / chars,
        len(set(words)) / max(n, 1) ** 0.5,
        len(set(lines)) / max(len(lines), 1),
        chars / max(n, 1),
        sum(x.rstrip().endswith(_ENDED) for x in lines) / max(len(lines), 1),
    )


def votes(stats: np.ndarray) -> np.ndarray:
    """The labellers, one column each. All vote both ways and nearly always, so they overlap; between two bounds they say nothing."""
    s = dict(zip(STATISTICS, stats.T, strict=True))
    vote = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NOTHING))
    return np.stack([
        vote(s["symbols"] > 0.02, s["symbols"] < 0.003),
        vote((s["shouts"] > 0.1) | (s["capitals"] > 0.2), (s["shouts"] < 0.02) & (s["capitals"] < 0.1)),
        np.where(s["words"] > 20, vote(s["varied"] < 3, s["varied"] > 5), NOTHING),
        vote(s["lines"] < 0.8, (s["lines"] > 0.95) & (s["words"] > 20)),
        vote(s["letters"] < 0.72, s["letters"] > 0.77),
        vote((s["length"] < 4) | (s["length"] > 7.2), (s["length"] > 4.5) & (s["length"] < 6.9)),
        vote(s["ended"] < 0.7, s["ended"] > 0.9),
        vote(s["capitals"] > 0.06, s["capitals"] < 0.04),
    ], axis=1)


@dataclass
class LabelModel:
    names: list[str]
    prior: float  # of good
    tables: np.ndarray  # [labeller, class, vote + 1]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) of rows of votes."""
        log = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(patterns), 0)
        for i in range(patterns.shape[1]):
            log += np.log(self.tables[i][:, patterns[:, i] + 1]).T
        log -= log.max(1, keepdims=True)
        return np.exp(log[:, 1]) / np.exp(log).sum(1)

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = self.tables[:, 0, 1] * p[0] + self.tables[:, 1, 2] * p[1]
        return dict(zip(self.names, right / (self.tables[:, :, 1:].sum(2) @ p), strict=True))


def expectation_maximisation(names: list[str], patterns: np.ndarray, rows: np.ndarray, rounds: int = 300, prior_rows: float = 20) -> LabelModel:
    """Accuracies from the number of rows of each pattern.

    Starts from labellers that are somewhat better than chance. That belief counts as ``prior_rows`` rows of each class,
    however many rows there are, so accuracies are estimates from where the labellers agree and disagree.
    """
    k = patterns.shape[1]
    believed = np.array([[0.3, 0.5, 0.2], [0.3, 0.1, 0.6]])  # of a bad, then of a good document: no vote, bad, good
    model = LabelModel(names, 0.8, np.tile(believed, (k, 1, 1)))
    if not len(rows) or not rows.sum():
        return model
    for _ in range(rounds):
        good = model.posterior(patterns)
        weight = np.stack([(1 - good) * rows, good * rows])
        new = np.tile(believed * prior_rows, (k, 1, 1))
        for i in range(k):
            for c in range(2):
                new[i, c] += np.bincount(patterns[:, i] + 1, weight[c], 3)
        new /= new.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (rows.sum() + 2))
        moved = np.abs(new - model.tables).max() + abs(prior - model.prior)
        model = LabelModel(names, prior, new)
        if moved < 1e-7:
            break
    return model


@dataclass
class Scorer:
    idf: np.ndarray
    weights: np.ndarray  # of n-grams, statistics' bins, and the bias

    def score(self, x: np.ndarray, bins: np.ndarray) -> np.ndarray:
        z = x @ self.weights[: x.shape[1]] + self.weights[x.shape[1] + bins].sum(1) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Bins of each statistic in the hashed space.
BINS = 32


def bins(stats: np.ndarray) -> np.ndarray:
    """A slot for each statistic by its size on a scale of square roots."""
    level = np.clip(np.sqrt(np.nan_to_num(stats)) * np.array([1, 30, 60, 20, 40, 6, 30, 5, 30])[None, :], 0, BINS - 1).astype(int)
    return level + BINS * np.arange(stats.shape[1])[None, :]


def train(x: np.ndarray, b: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps with averaging per coordinate (Adagrad)."""
    dims, extra = x.shape[1], BINS * b.shape[1]
    one_hot = np.zeros((len(x), extra), np.float32)
    np.put_along_axis(one_hot, b, 1, axis=1)
    full = np.concatenate([x, one_hot, np.ones((len(x), 1), np.float32)], axis=1)
    w, seen, y = np.zeros(dims + extra + 1, np.float32), np.full(dims + extra + 1, 1e-8, np.float32), y.astype(np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        g = full.T @ (p - y) / np.float32(len(y)) + np.float32(ridge) * w
        seen += g * g
        w -= np.float32(rate / 10) * g / np.sqrt(seen)
    return w.astype(np.float32)


@dataclass
class Model:
    labels: LabelModel
    scorer: Scorer | None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows: document frequencies of n-grams (key 0), and rows of each vote pattern (key 1)."""
    df, seen = np.zeros(DIMS + 1, np.int64), np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        texts = [x or "" for x in batch.column(0).to_pylist()]
        if texts:
            np.add.at(seen, (votes(np.array([statistics(t) for t in texts])) + 1) @ 3 ** np.arange(len(LABELLERS)), 1)
        for text in texts:
            c = counts(text)
            if c is not None:
                df[:-1] += c > 0
                df[-1] += 1
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([df.tobytes(), seen.tobytes()], pa.binary())], ["key", "vec"])


def _sample(model: LabelModel, idf):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x or "" for x in batch["text"]]
            x, _ = tfidf(texts, idf.value)
            stats = np.array([statistics(t) for t in texts]).reshape(len(texts), -1)
            yield pd.DataFrame({"x": [v.astype(np.float16).tobytes() for v in x], "stats": stats.tolist(), "y": model.posterior(votes(stats))})

    return run


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["y", "x"])
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
    return pd.DataFrame({"w": [train(x, bins(np.array(rows["stats"].tolist())), rows["y"].to_numpy()).tobytes()]})


def fit(docs: DataFrame, sample: int = 3000) -> Model:
    """Learn from ``docs(doc_id, text)``. Vote patterns and document frequencies are counted over all rows; the scorer learns from about ``sample`` rows chosen by a hash."""
    spark = docs.sparkSession
    df, seen = np.zeros(DIMS + 1, np.int64), np.zeros(3 ** len(LABELLERS), np.int64)
    for r in sum_vectors(docs.select("text").mapInArrow(_count, "key int, vec binary")).collect():  # two vectors
        if r["key"]:
            seen = seen + np.frombuffer(r["vec"], np.int64)
        else:
            df = df + np.frombuffer(r["vec"], np.int64)
    total, on = int(seen.sum()), np.flatnonzero(seen)
    patterns = on[:, None] // 3 ** np.arange(len(LABELLERS))[None, :] % 3 - 1
    labels = expectation_maximisation(list(LABELLERS), patterns, seen[on].astype(float))
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    vectors = docs.where(share * total < sample).select("text").mapInPandas(_sample(labels, spark.sparkContext.broadcast(idf)), "x binary, stats array<double>, y double")
    found = vectors.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_train, "w binary").collect()  # a bounded group
    return Model(labels, Scorer(idf, np.frombuffer(found[0]["w"], np.float32)) if found else None)


def _score(model, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            stats = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
            posterior = m.labels.posterior(votes(stats))
            score = posterior
            if m.scorer is not None and texts:
                score = m.scorer.score(tfidf(texts, m.scorer.idf)[0], bins(stats)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior), pa.array(score), pa.array(score >= keep)], ["doc_id", "posterior", "score", "kept"])

    return run


def classify(docs: DataFrame, keep: float = 0.3) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the linear scorer, 0 to 1), kept (score >= keep) of every row of ``docs(doc_id, text, ...)``.

    No labels are read. Null text counts as empty; repeated rows get equal results; very long texts are read whole; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(spark.sparkContext.broadcast(fit(docs)), keep), "doc_id long, posterior double, score double, kept boolean")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior, score and decision of all documents; odd rows as in ``classify``."""
    return classify(table(spark, sf_dir, "documents"))

"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector x is kept as int8 codes q and a scale s, with the exact rest |x - q/s|. For two vectors
    |x.y - (qx.qy)/(sx*sy)| <= |x - qx/sx| * |qy/sy| + |y - qy/sy|
so a pair whose quantised product plus that bound is below the threshold can't be a link; all other pairs are
computed again from the full components in double precision. Products of codes are exact in float32 for up to 1,024
components at a time.

Equal vectors of a label are one representative with a weight. Representatives lie in tiles by label and by their place
on a fixed random direction: linked unit vectors are within sqrt(2 - 2t) of each other, so only tiles whose slices are
that close are multiplied. A first round multiplies codes alone, one byte a component, and says which rows of which tile
pairs may link; only for those the components travel. A tile product returns link counts and a spanning forest, never its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import bounded, components, join_classes, stage, table

#: Most representatives of a tile.
TILE = 1024
#: Added to every bound for the rounding of double precision.
SLACK = 1e-9


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, rests and the norms of the quantised vectors, of unit rows x."""
    scale = 127.0 / np.abs(x).max(axis=1)
    codes = np.rint(x * scale[:, None]).astype(np.int8)
    back = codes / scale[:, None]
    return codes, scale, np.linalg.norm(x - back, axis=1), np.linalg.norm(back, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


def may_link(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Matrix of the pairs of quantised rows whose product plus the bound of its error reaches the threshold."""
    (qa, sa, ra, _), (qb, sb, rb, nb) = a, b
    return _code_products(qa, qb) / (sa[:, None] * sb[None, :]) + (ra[:, None] * nb[None, :] + rb[None, :]) + SLACK >= threshold


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i of a, j of b) of the pairs with cosine >= threshold; a and b hold rows of any length but zero."""
    ua, ub = unit(a.astype(np.float64)), unit(b.astype(np.float64))
    i, j = np.nonzero(may_link(quantise(ua), quantise(ub), threshold))
    good = np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + chunk]], ub[j[k : k + chunk]]) >= threshold for k in range(0, len(i), chunk)] or [np.zeros(0, bool)])
    return i[good], j[good]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row number reachable from each of n rows over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pack(kind):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        x = np.asarray(rows["v"].tolist(), np.float64)
        codes, scale, rest, norm = quantise(unit(x))
        first = {c: rows[c].iloc[:1] for c in ("label", "dims", "slice", "sub")}
        arrays = {"reps": rows["rep"].to_numpy(np.int64), "weights": rows["weight"].to_numpy(np.int64), "x": x.astype(kind), "codes": codes, "bounds": np.stack([scale, rest, norm])}
        return pd.DataFrame({**first, **{c: [v.tobytes()] for c, v in arrays.items()}})

    return run


def _screen(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples():
                sides = []
                for codes, bounds in ((t.codes, t.bounds), (t.codes2, t.bounds2)):
                    bounds = np.frombuffer(bounds).reshape(3, -1)
                    sides.append((np.frombuffer(codes, np.int8).reshape(bounds.shape[1], -1), *bounds))
                near = may_link(*sides, threshold)
                if (t.slice, t.sub) == (t.slice2, t.sub2):
                    near = np.triu(near, 1)
                    rows = columns = near.any(1) | near.any(0)
                else:
                    rows, columns = near.any(1), near.any(0)
                if rows.any():
                    out.append((t.label, t.dims, t.slice, t.sub, t.slice2, t.sub2, np.packbits(rows).tobytes(), np.packbits(columns).tobytes()))
            yield pd.DataFrame(out, columns=["label", "dims", "slice", "sub", "slice2", "sub2", "rows", "columns"])

    return run


def _multiply(threshold: float, kind):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                on = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(r) // 8].astype(bool) for m, r in ((t.rows, t.reps), (t.columns, t.reps2))]
                reps = [np.frombuffer(r, np.int64)[o] for r, o in zip((t.reps, t.reps2), on, strict=True)]
                weights = [np.frombuffer(w, np.int64)[o] for w, o in zip((t.weights, t.weights2), on, strict=True)]
                a, b = (np.frombuffer(x, kind).reshape(len(o), -1)[o] for x, o in zip((t.x, t.x2), on, strict=True))
                i, j = tile_links(a, b, threshold)
                if same := (t.slice, t.sub) == (t.slice2, t.sub2):
                    i, j = i[i < j], j[i < j]
                links = np.bincount(i, weights[1][j], len(a)).astype(np.int64), np.bincount(j, weights[0][i], len(b)).astype(np.int64)
                ids, links = (reps[0], links[0] + links[1]) if same else (np.concatenate(reps), np.concatenate(links))
                root = forest(i, j if same else j + len(a), len(ids))
                linked = np.flatnonzero(links)
                if len(linked):
                    yield pd.DataFrame({"a": ids[linked], "b": ids[root[linked]], "links": links[linked]})

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, seed: int = 11) -> DataFrame:
    """One row per row of ``vectors(vec_id, embedding, label, ...)``: vec_id, n_links, component_id, kept.

    Vectors of equal label (and equal length) link when their cosine is at least ``threshold``. Rows with a null id, label or
    vector, a zero vector, or a null, infinite or NaN component link with nothing: n_links 0, component_id = vec_id.
    Repeated rows count as vectors of their own. ``component_id`` is the smallest vec_id reachable; ``kept`` says that it is the row's own.
    An empty table gives no rows; other columns, texts of any length among them, are not read.
    """
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c + F.lit(0.0))  # no negative zero
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dims", F.size("v"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), np.int32)
        for dims, at in v.groupby(v.map(len)).groups.items():
            direction = np.random.default_rng([seed, int(dims)]).normal(size=int(dims))
            out[v.index.get_indexer(at)] = np.floor(unit(np.asarray(v[at].tolist())) @ (direction / np.linalg.norm(direction)) / (reach + SLACK))
        return pd.Series(out)

    classes = stage(classes.withColumn("slice", place("v")), "vector-classes", batch_rows=2000)
    key = ["label", "dims", "slice"]
    subs = bounded(stage(classes.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("subs")), "vector-slices"))
    tiled = classes.join(subs, key).withColumn("sub", F.pmod(F.xxhash64("rep"), "subs").cast("int")).repartition(*key, "sub")
    tiles = tiled.groupBy(*key, "sub").applyInPandas(_pack(kind), "label long, dims int, slice int, sub int, reps binary, weights binary, x binary, codes binary, bounds binary")
    tiles = stage(tiles, "vector-tiles", batch_rows=8)
    names = tiles.select(*key, "sub")
    near = names.withColumn("slice2", F.explode(F.array("slice", F.col("slice") + 1)))
    pairs = near.join(names.select("label", "dims", F.col("slice").alias("slice2"), F.col("sub").alias("sub2")), ["label", "dims", "slice2"])
    pairs = pairs.where((F.col("slice") < F.col("slice2")) | (F.col("sub") <= F.col("sub2")))
    def both(pairs: DataFrame, *columns: str) -> DataFrame:
        other = tiles.select("label", "dims", *(F.col(c).alias(f"{c}2") for c in ("slice", "sub", *columns)))
        return pairs.join(tiles.select(*key, "sub", *columns), [*key, "sub"]).join(other, ["label", "dims", "slice2", "sub2"])

    screened = both(pairs, "codes", "bounds").mapInPandas(_screen(threshold), "label long, dims int, slice int, sub int, slice2 int, sub2 int, rows binary, columns binary")
    screened = stage(screened, "vector-screen", batch_rows=8)
    found = stage(both(screened, "reps", "weights", "x").mapInPandas(_multiply(threshold, kind), "a long, b long, links long"), "vector-links", batch_rows=8)
    roots = components(found.select("a", "b")).select(F.col("id").alias("rep"), "component_id")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    result = stage(
        classes.join(links, "rep", "left").join(roots, "rep", "left")
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), "weight"),
        "vector-results",
    )
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_classes(rows.where("ok").select("vec_id", "label", "v"), result, ["label", "v"], "inner").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; odd rows as in ``embedding_links``."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a AS id, b AS dst FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.dst = l.a),
c AS (SELECT id, min(dst) AS low FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.low, vec_id)) AS component_id,
       least(vec_id, coalesce(c.low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.id = vec_id
"""

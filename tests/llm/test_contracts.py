"""The registered queries on sf0.001 and small tables: SQL, contracts, laws."""

import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from treesync.llm import common, embed_dedup, exact_dedup, queries, shuffle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, documents, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    columns = want.columns
    got = queries.queries()[name](spark, SF).select(*columns).collect()
    assert Counter(map(str, map(tuple, got))) == Counter(map(str, want.fetchall()))


def test_sharding_contract(spark, documents):
    out = queries.queries()["op3_sharding"](spark, SF).collect()
    text = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert sorted(r["doc_id"] for r in out) == sorted(text) and {r["law"] for r in out} == {"rows"}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None for r in out)
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n)) for s, n in counts.items())


def chi_square(seen: Counter, p: dict, draws: int) -> tuple[float, int]:
    used = {k: v for k, v in p.items() if v * draws >= 5}
    rest = draws - sum(seen[k] for k in used)
    x = sum((seen[k] - v * draws) ** 2 / (v * draws) for k, v in used.items())
    left = (1 - sum(used.values())) * draws
    return x + (rest - left) ** 2 / max(left, 1), len(used)


def choose(n: int, k: int) -> int:
    return math.prod(range(n - k + 1, n + 1)) // math.factorial(k) if 0 <= k <= n else 0


@pytest.mark.parametrize(("good", "bad", "n"), [(20, 30, 15), (30, 20, 35), (7, 3_000_000_000, 900_000_000), (40, 5_000_000_000, 2_000_000_000), (2_000_000_000, 40, 1_999_999_990)])
def test_hypergeometric_law(monkeypatch, good, bad, n):
    monkeypatch.setattr(shuffle, "NUMPY_BELOW", 0)
    rng, draws, total = np.random.default_rng(4), 8000, good + bad
    seen = Counter(shuffle.hypergeometric(rng, good, bad, n) for _ in range(draws))
    few, flip = min(good, bad), good > bad
    p = {k: choose(n, k) * choose(total - n, few - k) / choose(total, few) for k in range(few + 1)}
    x, cells = chi_square(Counter({(n - k if flip else k): v for k, v in seen.items()}), p, draws)
    assert x < cells + 5 * math.sqrt(2 * cells) + 5, (x, cells)


def test_large_draws_have_the_right_moments():
    rng, sizes = np.random.default_rng(5), np.array([3 * 10**9, 5 * 10**11, 2 * 10**11])
    draws = np.array([shuffle._draw(rng, sizes, 10**11) for _ in range(300)])
    assert (draws.sum(1) == 10**11).all()
    share = sizes / sizes.sum()
    spread = np.sqrt(10**11 * share * (1 - share) * (1 - 10**11 / sizes.sum()))
    assert (np.abs(draws.mean(0) - 10**11 * share) < 5 * spread / math.sqrt(300)).all() and (np.abs(draws.std(0) / spread - 1) < 0.25).all()


def test_every_row_may_go_anywhere(spark):
    df = spark.range(12).repartition(3).cache()
    seen = Counter()
    for seed in range(20):
        seen.update((r["id"], r["shard"]) for r in shuffle.uniform_shuffle(df, shards=3, seed=seed).collect())
    assert sum((seen[i, s] - 20 / 3) ** 2 / (20 / 3) for i in range(12) for s in range(3)) < 24 + 5 * math.sqrt(48)


def test_hot_classes_and_clashing_names(spark):
    rows = [(i, "same text", i, "x", 1) for i in range(700)] + [(700 + i, f"text {i}", i, "y", 2) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, sha string, longest int")
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(df).collect()) == [0, 700, 701, 702, 703, 704] and exact_dedup.drop_copies(df).columns == df.columns
    vectors = spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(600)] + [(600, [1.0, 2.01], 1), (601, [-1.0, 0.0], 1), (602, None, 1)], "vec_id long, embedding array<double>, label int")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.embedding_links(vectors).collect()}
    assert out[5] == (600, 0) and out[600] == (600, 0) and out[601] == (0, 601) and out[602] == (0, 602)
    assert embed_dedup.embedding_links(vectors.where("false")).count() == 0 and common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        common.components(spark.createDataFrame([(1, 2), (3, 2), (3, 4)], "a long, b long"), max_rounds=0)

"""Estimated accuracies and decisions against the given labels, which the model never reads."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from treesync.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return np.array([labels.get(d["doc_id"], -1) for d in docs]), quality.votes(np.array([quality.statistics(d["text"] or "") for d in docs]))


def fitted(votes):
    patterns, back, rows = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.expectation_maximisation(list(quality.LABELLERS), patterns, rows.astype(float))
    return model, model.posterior(patterns)[back.ravel()]


def test_accuracies_are_near_the_true_ones(labelled):
    labels, votes = labelled
    assert ((votes >= 0).sum(1) >= 2).mean() > 0.99
    model, posterior = fitted(votes)
    for i, name in enumerate(quality.LABELLERS):
        on = (labels >= 0) & (votes[:, i] >= 0)
        assert abs(model.accuracies()[name] - (votes[on, i] == labels[on]).mean()) < 0.08, name
    assert (posterior[labels == 1] >= 0.5).mean() > 0.95 and (posterior[labels == 0] >= 0.5).mean() < 0.05


def test_the_prior_does_not_grow_with_the_rows(labelled):
    _, votes = labelled
    one, many = (fitted(np.tile(votes, (n, 1)))[0].accuracies() for n in (3, 30))
    assert all(abs(one[k] - many[k]) < 0.02 for k in one)


def test_a_poor_labeller_is_found_out():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.7
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.55, 0.9, 0.9]
    votes = np.stack([np.where(rng.random(4000) < r, truth, ~truth) for r in right], 1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.NOTHING
    got = list(fitted(votes)[0].accuracies().values())
    assert np.abs(np.array(got) - right).max() < 0.04


def test_scores_follow_the_labels(spark, labelled):
    labels, _ = labelled
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    of = {i: labels[k] for k, i in enumerate(pq.read_table(f"{SF}/documents.parquet").column("doc_id").to_pylist())}
    kept = {c: np.mean([out[i]["kept"] for i in ids if of[i] == c]) for c in (0, 1)}
    assert kept[1] > 0.97 and kept[0] < 0.2 and all(0 <= r["score"] <= 1 for r in out.values())
    twice = quality.classify(docs.limit(20).union(docs.limit(20))).collect()
    assert len(twice) == 40 and len({(r["doc_id"], round(r["score"], 6)) for r in twice}) == len({r["doc_id"] for r in twice})

"""What the toxicity model learns, against plain counts and planted terms."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from treesync.llm import toxicity


def test_evidence_is_the_likelihood_ratio():
    rng = random.Random(1)
    for _ in range(200):
        n1, n0 = rng.randint(1, 300), rng.randint(1, 3000)
        a, b = rng.randint(0, n1), rng.randint(0, n0)
        g = 0.0
        for o, row, col in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)):
            g += 2 * o * math.log(o * (n1 + n0) / (row * col)) if o else 0
        want = g if a / n1 > b / n0 else 0.0
        assert toxicity.evidence(np.array([float(a)]), np.array([float(b)]), n1, n0)[0] == pytest.approx(want, abs=1e-7)
    assert toxicity.chance(3.841459) == pytest.approx(0.025, rel=1e-4) and toxicity.chance(0) == 1.0


def test_told_apart_is_the_step_up_rule():
    rng = random.Random(2)
    for _ in range(100):
        chances = {f"t{i}": rng.random() ** rng.choice([1, 6]) for i in range(30)}
        want, m = set(), 50
        for t, p in chances.items():
            if any(p <= q <= sum(x <= q for x in chances.values()) * 0.1 / m for q in chances.values()):
                want.add(t)
        assert toxicity.told_apart(chances, m, 0.1) == want
    assert toxicity.told_apart({}, 0, 0.05) == set()


def test_chance_fragments_are_no_terms():
    """Of many words of which none has to do with the label, hardly any is learnt; planted ones are, however few groups there are."""
    rng = np.random.default_rng(3)
    n1, n0, often, rare = 250, 2300, {}, {}
    for i in range(20_000):
        p = 10 ** rng.uniform(-3.5, -0.5)
        often[f"w{i}"], rare[f"w{i}"] = float(rng.binomial(n1, p)), float(rng.binomial(n0, p))
    often |= {"planted": 30.0, "plain": 200.0, "slurred": 20.0, "slurring": 15.0, "slur*": 34.0, "lonely": 9.0, "lone*": 9.0}
    rare |= {"plain": 1800.0}
    words, stems, members = toxicity.lexicon_terms(often, rare, n1, n0, len(often), 50.0, 0.05)
    assert {"planted", "lonely"} <= set(words) and (stems, members) == (["slur"], ["slurred", "slurring"]) and "plain" not in words and len([w for w in words if w[0] == "w"]) <= 1
    assert toxicity.lexicon_terms({"bad": 4.0, "one": 1.0}, {}, 4, 3000, 5000, 50.0, 0.05) == (["bad"], [], [])
    assert toxicity.lexicon_terms({}, {}, 1, 1, 0, 50.0, 0.05) == ([], [], [])


def test_groups():
    rng = random.Random(4)
    rows = pd.DataFrame([(rng.randint(0, 1), rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)], columns=["toxic", "m0", "m1"])
    groups = toxicity._groups(rows, ["m0", "m1"])
    near = {i: {j for j in range(60) if rows["toxic"][i] == rows["toxic"][j] and (rows["m0"][i] == rows["m0"][j] or rows["m1"][i] == rows["m1"][j])} for i in range(60)}
    for i in range(60):
        reached, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - reached
            reached |= new
            todo += new
        assert {j for j in range(60) if groups[j] == groups[i]} == reached


@pytest.fixture(scope="module")
def quoted(spark):
    """The same terms used directly (toxic) and in quotation (not), with spellings; copies of one text have a word of their own."""
    rng = random.Random(5)
    plain = ["".join(rng.choices("bcdfglmnprst", k=3)) + rng.choice("aeiou") + "".join(rng.choices("bcdfglmnprst", k=3)) for _ in range(3000)]
    terms = ["grelbag", "snorvex", "wumplik"]
    fill = lambda n: rng.sample(plain, n)
    rows = []
    for i in range(2400):
        words = fill(30)
        if i < 300:
            words[rng.randrange(30)] = terms[i % 3]
        elif i < 345:
            words[10:10] = ["he", "said", f'"you', terms[i % 3], 'there"', "and", "left"]
        rows.append((i, " ".join(words), int(i < 300)))
    copied = " ".join([*fill(40), "onlycopied", terms[0]])
    rows += [(3000 + i, copied, 1) for i in range(200)]
    return rows


def test_quotation_and_copies(spark, quoted):
    docs = spark.createDataFrame(quoted, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), purity=20.0)
    known = {*model.lexicon.words, *model.lexicon.stems}
    assert {"grelbag", "snorvex", "wumplik"} <= known and "onlycopied" not in known and len(known) <= 4
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [i for i, *_ in quoted if (__import__("zlib").crc32(str(i).encode()) % 3) == 1]
    share = lambda ids: sum(out[i] >= 0.7 for i in ids) / len(ids)
    assert share([i for i in held if i < 300]) > 0.95 and share([i for i in held if 300 <= i < 345]) < 0.2 and share([i for i in held if 345 <= i < 2400]) < 0.01
    assert model.weights[3] < model.weights[1] + model.weights[2]
    odd = spark.createDataFrame([(1, "x" * 500_000), (2, "中文没有空格" * 1000), (None, None), (4, ""), (5, ("grelbga " * 20_000)), (6, "snorvex"), (6, "snorvex")], "doc_id long, text string")
    found = [(r["doc_id"], r["predicted"]) for r in toxicity.score(odd, model).collect()]
    assert sorted(found, key=str) == sorted([(1, 0), (2, 0), (None, 0), (4, 0), (5, 1), (6, 1), (6, 1)], key=str)

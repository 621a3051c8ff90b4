"""The filter audit, decontamination and vector codes against brute force, with odd rows."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from treesync.llm import decontaminate, filter_audit, vector_codes

RNG = random.Random(3)


def words_text(n, vocabulary):
    return " ".join(RNG.choice(vocabulary) for _ in range(n))


def plain_fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text))


@pytest.fixture(scope="module")
def audited():
    few, many = ["é", "Ab", "x#", "y"], [f"w{i}" for i in range(400)] + ["\x1cq", "a b"]
    texts = [words_text(RNG.choice([0, 3, 49, 50, 51, 80]), RNG.choice([few, many])) for _ in range(60)] + [None, "", "B" * 300_000 + " é" * 100]
    rows = [(i if i % 13 else None, RNG.choice(texts), RNG.choice(["s", "t", None, ""]), i, i) for i in range(300)]
    rows += rows[5:9]
    labels = [(i, RNG.choice([0, 1, None]), RNG.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    return rows, labels


def test_filter_audit(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask int, digest int")
    out = filter_audit.filter_audit(docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = {}
    for d, t, s, *_ in rows:
        parts.setdefault(s or "", []).append((d, plain_fails(t or "") + "E" * (d is not None and least[t or ""] < d)))
    assert len(out) == len(parts) * 600 and set(parts) == {r["part"] for r in out}
    got = {(r["part"], r["filter_order"], r["step"]): r for r in out}
    for part, members in parts.items():
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone, stay = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                r = got[part, order, step]
                assert (r["kept"], r["removed"], r["redundant"]) == (len(stay), len(gone), sum(f in x for _, x in members) - len(gone))
                assert r["unique_fails"] == sum(x == f for _, x in members) and (r["good_lost"], r["toxic_lost"]) == (sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
                removed_in_all[f] += len(gone)
                left = stay
        assert all(r["shapley"] == removed_in_all[r["filter_order"][r["step"] - 1]] for (p, _, _), r in got.items() if p == part)
    assert filter_audit.filter_audit(docs.where("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_zeta():
    counts = np.array([RNG.randrange(9) for _ in range(32)])
    assert [sum(int(counts[m]) for m in range(32) if not m & s) for s in range(32)] == filter_audit.survivors(counts).tolist()


def plain_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found |= {item} - {None}
    return len(words), hit, found


@pytest.fixture(scope="module")
def benchmark_rows():
    small = ["Ab", "c", "ñé", "7", "Ünd"]
    items = [(i, words_text(n, small)) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 40])] + [(None, "null item of three"), (5, "same id again"), (20, None), (21, "b" * 5000)]
    texts = [words_text(n, [*small, "other"]) for n in (0, 1, 5, 30, 200)]
    for i, t in items:
        texts += [f"before--{(t or '').upper()}... after", words_text(8, small) + ";" + (t or "") + "\x00" + words_text(8, small)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, texts[-1], "x", 0), (3, texts[3], "x", 0), (3, texts[3], "x", 0), (99, None, "x", 0)]
    return items, rows


@pytest.mark.parametrize("most", [10**6, 60])
def test_contamination(spark, benchmark_rows, most):
    items, rows = benchmark_rows
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, row string, items int"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs.repartition(3), bench, most_windows=most).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        n, hit, found = plain_hits(text[r["doc_id"]], items)
        assert r["n_words"] == n and {w for h in r["hits"] for w in range(h["start"], h["end"])} == hit and r["items"] == sorted(found)
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text[r["doc_id"]]))]
        assert all((h["first"], h["last"]) == (places[h["start"]][0], places[h["end"] - 1][1]) for h in r["hits"])
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    assert all(not r["hits"] for r in decontaminate.contamination(docs, bench.where("false")).collect())


def test_scan_in_pieces(monkeypatch, benchmark_rows):
    items, rows = benchmark_rows
    automaton = decontaminate.Automaton([(i, (t or "").encode()) for i, t in items])
    text = " ".join((r[1] or "") for r in rows) + "ü" * 100
    whole = automaton.scan(text.encode()), decontaminate.word_places(text.encode(), automaton.scan(text.encode())[1])
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(decontaminate.pieces, "__defaults__", (size,))
        assert (automaton.scan(text.encode()), decontaminate.word_places(text.encode(), whole[0][1])) == whole
    assert whole[0][0] == plain_hits(text, [])[0] and whole[0][2] == plain_hits(text, items)[2]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(4096 * x)) for x in r[1]]))
    width = -(-len(kept[0][1]) // parts)
    cut = lambda v: [[int(np.floor(4096 * x)) for x in v][p * width : (p + 1) * width] for p in range(parts)]
    cut_all = [[part + [0] * (width - len(part)) for part in cut(r[1])] for r in kept]
    books = [[v[p] for v in cut_all[:entries]] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        chosen = [[near(v[p], p)[1] for p in range(parts)] for v in cut_all]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, c in zip(cut_all, chosen, strict=True) if c[p] == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(x) // len(mine) for x in zip(*mine, strict=True)], *books[p][e + 1 :]]
    out, errors = [], {}
    for r, v in zip(kept, cut_all, strict=True):
        best = [near(v[p], p) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), r[2]))
        errors[r[2]] = errors.get(r[2], 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), c, e, errors[label], sha) for i, c, e, label in out)


@pytest.mark.parametrize(("n", "dims"), [(300, 16), (40, 11), (5, 8), (30, 3)])
def test_vector_codes(spark, n, dims):
    rng = np.random.default_rng(n)
    rows = [(i * 3 % 97, np.round(rng.normal(size=dims), 1).tolist(), int(rng.integers(3)) if i % 5 else None) for i in range(n)]
    rows += [(500, None, 1), (501, [float("nan")] * dims, 1), (502, [float("-inf")] + [0.0] * (dims - 1), 1), (503, [None] * dims, 1), (None, [0.25] * dims, 1), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int")
    out = vector_codes.vector_codes(df.repartition(3)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out) == plain_codes(rows)


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    assert {(r["code"], r["error"]) for r in vector_codes.vector_codes(spark.createDataFrame([(1, [], "a"), (2, [], None)], schema)).collect()} == {("00" * 8, 0)}
    for bad in ([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], [(1, [1e9], "a")]):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(spark.createDataFrame(bad, schema))
    big = np.array([[-(3 * 10**7), 2], [3 * 10**7, 2]])
    assert vector_codes.squares(big, big).tolist() == [[0, 36 * 10**14], [36 * 10**14, 0]]

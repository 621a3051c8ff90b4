"""The pipeline's stages, each on what its predecessor kept, and the whole against brute force; languages by plain cosines."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_pii import PATTERNS, valid
from treesync.llm import langid, packing
from treesync.llm.common import stage
from treesync.llm.ngrams import DIMS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOUNDS = {"aa": ["ka", "lo", "mi", "tu", "ne"], "bb": ["sch", "ung", "er", "ich", "ott"]}


def made(seed=4):
    """Copies that differ in blanks, near copies, personal data, and odd rows, in two languages."""
    rng = random.Random(seed)
    text = lambda x, n: " ".join("".join(rng.choices(SOUNDS[x], k=4)) for _ in range(n))
    texts = []
    for i in range(150):
        lang = ("aa", "bb")[i % 2]
        base = text(lang, rng.randint(3, 90))
        texts.append((base, lang))
        if i % 5 == 0:
            texts += [(base.replace(" ", rng.choice(["  ", "\n", "\t "]), 2), lang), (base, lang)]
        if i % 7 == 0:
            words = base.split()
            words[rng.randrange(len(words))] = text(lang, 1)
            texts.append((" ".join(words), lang))
        if i % 6 == 0:
            texts.append((base[: len(base) // 2] + f" x{i}@mail{i}.example.com, 10.0.0.{i} +49 (30) 12345{i:03} 4111 1111 1111 1111 " + text(lang, 40), lang))
    texts += [(None, "aa"), ("", "bb"), ("123 456", None), ("\n \t", "aa"), ("kalo " * 20_000, "aa"), (text("bb", 30), None)]
    rng.shuffle(texts)
    return [(i, t, lang, rng.choice(["s1", None]), len(t or "")) for i, (t, lang) in enumerate(texts)]


def grams(text):
    """Counts of 1- to 3-grams of folded letters, hashed with plain integers."""
    folded = [0]
    for c in [*(text or ""), " "]:
        low = c.lower()
        code = 0 if not c.isalpha() or ord(c) >= 0x3347F else ord(low) if len(low) == 1 else ord(c)
        if code or folded[-1]:
            folded.append(code)
    if len(folded) < 3:
        return Counter()
    p, q, whole = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 2**64
    two = [(a * p + b + 1) % whole for a, b in zip(folded, folded[1:])]
    three = [(a * p + b + 2) % whole for a, b in zip(two, folded[2:])]
    return Counter(((g * q % whole) >> 40) % DIMS for g in [*(f for f in folded if f), *two, *three])


def plain_languages(rows, model, ids=None):
    """First column -> (language, cosine, rejected) by the model's centroids, and the inverse document frequencies; ``ids`` where that isn't doc_id."""
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 1
    learnt = [grams(r[1]) for r, i in zip(rows, ids or [r[0] for r in rows], strict=True) if r[2] is not None and learns(i)]
    learnt = [g for g in learnt if g]
    df = Counter(k for g in learnt for k in g)
    idf = [math.log((1 + len(learnt)) / (1 + df[k])) + 1 for k in range(DIMS)]
    out = {}
    for i, t, *_ in rows:
        g = grams(t)
        if not g:
            out[i] = ("und", 0.0, True)
            continue
        x = {k: math.log1p(n) * idf[k] for k, n in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        cosines = [sum(v * float(c[k]) for k, v in x.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        out[i] = (model.langs[best], cosines[best], cosines[best] < model.floors[int(math.log2(sum(g.values())))])
    return out, idf


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def without_copies(rows):
    best = {}
    for r in rows:
        k = squeezed(r["text"])
        if k not in best or (-len(r["text"] or ""), r["doc_id"]) < (-len(best[k]["text"] or ""), best[k]["doc_id"]):
            best[k] = r
    return {r["doc_id"] for r in best.values()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def without_near_copies(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


def masked(text):
    found = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m[0]))
    out, at = [], 0
    for start, _, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def tokens():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.createDataFrame(made(), SCHEMA)
    out = [docs.collect()]
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, None), f"test-{name}")
        out.append(docs.collect())
    return out


def test_stage_language(spark, stages):
    model = langid.fit(spark.createDataFrame(made(), SCHEMA))
    want, idf = plain_languages(made(), model)
    assert np.allclose(idf, model.idf, rtol=1e-6)
    got = {r["doc_id"]: r["language"] for r in langid.identify(spark.createDataFrame(made(), SCHEMA), model).collect()}
    assert all(got[i]["lang"] == lang and got[i]["rejected"] == no and abs(got[i]["score"] - cos) < 1e-5 for i, (lang, cos, no) in want.items())
    before, after = stages[0], {r["doc_id"]: r for r in stages[1]}
    assert set(after) == {i for i, (_, _, no) in want.items() if not no}
    assert {r["doc_id"] for r in before} - set(after) == {r["doc_id"] for r in before if not re.search("[a-z]", r["text"] or "")}  # clean documents stay
    assert all(after[r["doc_id"]] == type(r)(**{**r.asDict(), "lang": want[r["doc_id"]][0]}) for r in before if r["doc_id"] in after)


def test_stage_exact(stages):
    want = without_copies(stages[1])
    assert sorted(stages[2]) == sorted(r for r in stages[1] if r["doc_id"] in want) and len(stages[2]) < len(stages[1]) - 50


def test_stage_near(stages):
    want = without_near_copies(stages[2])
    assert sorted(stages[3], key=lambda r: r["doc_id"]) == sorted((r for r in stages[2] if r["doc_id"] in want), key=lambda r: r["doc_id"]) and len(stages[3]) < len(stages[2])


def test_stage_pii(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert len(stages[4]) == len(before) and any("[EMAIL]" in r["text"] for r in stages[4])
    for r in stages[4]:
        text = masked(before[r["doc_id"]]["text"])
        assert r.asDict() == {**before[r["doc_id"]].asDict(), "text": text, "n_chars": len(text)}


def test_language_holds_few_vectors(spark):
    """Vectors of 32 KB a text are made for some texts at a time, not for a whole Arrow batch."""
    docs = spark.createDataFrame(made(), SCHEMA)
    predict = langid.predictor(spark, langid.fit(docs)).func
    texts = pd.Series([r[1] for r in made() if len(r[1] or "") < 5_000] * 3)[:500]
    want = pd.concat([predict(texts[:1]), predict(texts[1:130]), predict(texts[130:])], ignore_index=True)
    tracemalloc.start()
    got = predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts) == 500 and peak < 500 * DIMS * 4 / 2
    assert (got["lang"] == want["lang"]).all() and (got["rejected"] == want["rejected"]).all() and np.allclose(got["score"], want["score"], atol=1e-6)
    assert len(predict(texts[:0])) == 0


def test_packing_starts_no_second_pool(spark, monkeypatch):
    """A list of rows given to createDataFrame is an RDD of Python objects, for which executors start a daemon and workers beside those of SQL."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(type(spark.sparkContext), "parallelize", None)
        pieces = packing.pack(docs).collect()
    assert sorted((r["doc_id"], r["start"], r["sequence_id"]) for r in pieces) == [(1, 0, 0), (2, 0, 0)]


def check_packed(pieces, docs, tokens):
    """All ids of all documents once, in gapless sequences that are full but for the last."""
    ids = {i: tokens(t) for i, t in docs.items()}
    for i, parts in {i: sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"]) for i in ids}.items():
        at = 0
        for p in parts:
            piece = ids[i][at : at + p["length"]]
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and p["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    place = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert (p["sequence_id"], p["offset"]) == divmod(place, 2048)
        place += p["length"]
    assert {p["doc_id"] for p in pieces} == set(ids)


def test_stage_packing(stages, tokens):
    check_packed(stages[5], {r["doc_id"]: r["text"] for r in stages[4]}, tokens)


def test_whole_run(spark, tmp_path, tokens):
    rows = made(8)
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    row = spark.createDataFrame([], SCHEMA).schema
    kept = [dict(zip(row.names, r, strict=True)) for r in rows if re.search("[a-z]", r[1] or "")]
    for keep in (without_copies, without_near_copies):
        ids = keep(kept)
        kept = [r for r in kept if r["doc_id"] in ids]
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), {r["doc_id"]: masked(r["text"]) for r in kept}, tokens)


def test_odd_rows_and_no_rows(spark):
    """Every stage takes nulls in any column, repeated rows, empty and long texts, and columns named like inner ones."""
    rows = [(1, "Alpha beta gamma", "en"), (1, "Alpha beta gamma", "en"), (None, "Alpha beta gamma", None), (2, None, None), (3, "", "en"), (4, "a@b.co " * 20_000, "fr"), (None, None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "k", None, 3) for r in rows], "doc_id long, text string, lang string, block int, pos long, fp string, terms string, language int")
    kept = {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, None)
        assert name == "packing" or out.columns == docs.columns
        kept[name] = sorted(((r["doc_id"], r["text"] and r["text"][:12]) if name != "packing" else (r["doc_id"], r["doc_tokens"]) for r in out.collect()), key=str)
        assert function(spark, docs.where(F.lit(False)), None).count() == 0
    numbered = [(n, *r[1:]) for n, r in enumerate(rows)]  # ids repeat here
    found, _ = plain_languages(numbered, langid.fit(docs), [r[0] for r in rows])
    assert kept["language"] == sorted(((r[0], r[1][:12]) for n, r in enumerate(rows) if not found[n][2]), key=str) and len(kept["language"]) >= 3
    assert kept["exact_dedup"] == sorted([(1, "Alpha beta g"), (2, None), (4, "a@b.co a@b.c")], key=str)
    assert len(kept["pii"]) == 7 and kept["pii"].count((4, "[EMAIL] [EMA")) == 1
    assert {(i, n) for i, n in kept["packing"] if n == 1} == {(2, 1), (3, 1), (None, 1)}

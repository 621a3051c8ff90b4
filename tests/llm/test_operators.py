"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treesync.llm import bpe, common, embed_dedup, exact_dedup, jaccard_join, langid, packing, pii, quality, shuffle, toxicity

ODD = [(1, "Alpha beta gamma delta epsilon zeta.", "en", 1), (2, None, None, 2), (3, "", "en", 3), (None, "Alpha beta gamma", "en", 4), (4, "Alpha  beta gamma delta epsilon zeta.", "en", 5), (4, "Alpha  beta gamma delta epsilon zeta.", "en", 5), (5, "x" * 200_000, "fr", 6), (6, "é中\U0001f600 a@b.co", "fr", 7)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated rows, and columns named like inner ones."""
    return spark.createDataFrame([(*r[:3], r[3], r[3], "k", r[3]) for r in ODD], "doc_id long, text string, lang string, block int, pos long, fp string, n int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_golomb():
    rng = np.random.default_rng(0)
    for k in (0, 3, 9):
        v = np.unique(rng.integers(100, 5000, 300))
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, 100, k), len(v), 100, k) == v).all()


def test_exact_dedup(odd, none):
    out = exact_dedup.exact_dedup(odd, owners=3).collect()
    assert len(out) == len(ODD) and sum(r["kept"] for r in out) == 5
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} >= {(1, 4, 3), (4, 4, 3), (2, 2, 2), (3, 2, 2), (None, None, 1)}
    assert exact_dedup.drop_copies(odd).columns == odd.columns and exact_dedup.drop_copies(odd).count() == 5
    assert exact_dedup.exact_dedup(none).count() == 0


def test_shuffle(spark, odd, none):
    out = shuffle.uniform_shuffle(spark.range(1003).repartition(5), 16, rows_per_bin=10).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(len(v) for v in by.values()) == [62] * 5 + [63] * 11 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shuffle.uniform_shuffle(odd).count() == len(ODD) and shuffle.uniform_shuffle(none).count() == 0
    before, sizes = np.array([0, 3, 3, 10, 14]), shuffle.bin_sizes(14, 3, 2)
    rows = np.stack([shuffle.matrix_row(p, before, sizes, 1) for p in range(4)])
    assert (rows.sum(0) == sizes).all() and (rows.sum(1) == np.diff(before)).all()


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    x = [base[i % 40] + rng.normal(size=8) * (0.1 if i % 2 else 0.02) for i in range(160)]
    rows = [(i, v.astype(np.float32).tolist(), int(i % 40) % 3) for i, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, rows[0][1], rows[0][2]), (204, rows[0][1], None), (205, [None] * 8, 0)]
    out = {r["vec_id"]: r for r in embed_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=16).collect()}
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in rows if label is not None and i not in (200, 201, 202, 205)}
    label = {r[0]: r[2] for r in rows}
    root, links = {i: i for i in out}, dict.fromkeys(out, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and label[i] == label[j] and good[i] @ good[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (links[i], find(i), find(i) == i) for i in out}
    assert max(links.values()) > 1


def test_jaccard_join(spark, odd, none):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(30):
        base = rng.choices(words, k=rng.randint(1, 120))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
    sets = {i: set(jaccard_join.shingle_set(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == {(i, len(sets[i]), find(i)) for i in sets}
    links, classes = jaccard_join.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"))
    members = {}
    for i, x in sets.items():
        if x:
            members.setdefault(frozenset(x), []).append(i)
    named = {i: min(ids) for ids in members.values() for i in ids}
    assert {(r["doc_id"], r["class_id"]) for r in classes.collect()} == set(named.items())
    want = {tuple(sorted((named[i], named[j]))) for i in named for j in named if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and named[i] != named[j]}
    assert {(r["a"], r["b"]) for r in links.collect()} == want and want
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (None, None), (4, 1), (5, 5), (6, 6)}
    assert jaccard_join.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (300, 300)]
    out = {r["id"]: r["component_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out[50] == 0 and out[100] == 0 and out[201] == 200 and 300 not in out


def test_bpe(odd, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    tok.no_padding(), tok.no_truncation()
    want = {r[1] or "": tok.encode(r[1] or "", add_special_tokens=False).ids for r in ODD}
    ids = bpe.encode(odd)
    assert sorted(map(str, (r["ids"] for r in ids.collect()))) == sorted(str(want[r[1] or ""]) for r in ODD)
    assert sorted(r["decoded"] for r in bpe.decode(ids).collect()) == sorted(tok.decode(want[r[1] or ""], skip_special_tokens=False) for r in ODD)
    shown = {r["doc_id"]: r for r in bpe.digests(odd).collect()}
    assert shown[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want[ODD[0][1]])).encode()).hexdigest()
    assert bpe.digests(none).count() == 0


def test_bpe_streams_like_the_whole():
    machine, rng = bpe.model().machine, random.Random(5)
    for alphabet in ("ab", "theinrsx", "abcdefghijklmnopqrstuvwxyz"):
        word = "".join(rng.choices(alphabet, k=4000))
        parts = [word[i : i + 100] for i in range(0, len(word), 100)]
        assert list(machine.encode(parts)) == machine.merge([*word[:-1], word[-1] + "</w>"])
    assert machine.window < 2000


def test_packing(odd, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = sorted(packing.pack(odd, window=64, with_ids=True).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in out:
        assert (r["sequence_id"], r["offset"]) == divmod(place, 64) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        place += r["length"]
    stream = np.frombuffer(b"".join(r["ids"] for r in out), "<u4").tolist()
    docs, doc = [], []
    for i in stream:
        doc.append(i)
        if i == 1:
            docs.append(doc)
            doc = []
    assert sorted(docs) == sorted(tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in ODD)
    assert packing.pack(none).count() == 0
    encode = packing.byte_bpe_encoder()
    for text in ("a  b", " a", "a ", "a\n b", "it's <|endoftext|> x", "a \n", "é   z"):
        assert np.frombuffer(encode(text), np.uint16).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_pii(spark, odd, none):
    text = "mail x.y@mail.example.com, ip 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111 or 4111 1111 1111 1112, tel +49 (30) 1234567."
    df = spark.createDataFrame([(1, text, 1), (2, "a@b.c@d.e f@g", 2), (3, "9" * 5000 + "." + "7.1.2.3", 3)], "doc_id long, text string, pos int")
    spans = {r["doc_id"]: r["s"] for r in pii.sanitise(df).select("doc_id", pii.listed(pii.all_spans()).alias("s")).collect()}
    assert [x.split(":")[0] for x in spans[1].split(",")] == ["email", "ip", "card", "phone"] and spans[2] == "email:0:5"
    assert spans[3] == "ip:5001:5008" if "ip" in spans[3] else spans[3] == ""
    shown = pii.mask(df).where("doc_id = 1").first()["text"]
    assert shown == "mail [EMAIL], ip [IP] not 10.0.0.256, card [CARD] or 4111 1111 1111 1112, tel [PHONE]."
    assert pii.mask(odd).count() == len(ODD) and pii.mask(none).count() == 0 and pii.mask(odd).columns == odd.columns


def test_pii_terms(spark):
    places = "north south east west upper lower inner outer".split()
    rows = [(i, f"the {p} office of kestrel reach agent@example.com and the {p} desk") for i, p in enumerate(places)]
    rows += [(100 + i, f"the plain text and the {p} of nothing much {i}") for i in range(40) for p in places[:1]]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: {rows[r["doc_id"]][1][t["start"] : t["end"]] for t in r["terms"]} for r in out if r["doc_id"] < 100}
    assert all("kestrel" in v and "the" not in v for v in found.values()) and not any(r["terms"] for r in out if r["doc_id"] >= 100)


def test_language(spark, odd, none):
    rng = random.Random(1)
    sound = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"]}
    rows = [(i, " ".join("".join(rng.choices(sound[x], k=3)) for _ in range(30)), x) for i in range(200) for x in ("aa", "bb")[i % 2 : i % 2 + 1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert np.mean([out[i]["language"]["lang"] == x for i, _, x in rows]) == 1.0
    odd_out = langid.identify(odd, model).collect()
    assert len(odd_out) == len(ODD) and {r["language"]["lang"] for r in odd_out if not r["text"]} == {"und"}
    assert langid.identify(none, model).count() == 0 and langid.identify(odd, langid.fit(none)).where("not language.rejected").count() == 0


def test_toxicity(spark, odd, none):
    lexicon = toxicity.Lexicon(["idiot", "worthless"], ["lowei"])
    kinds = [lexicon.kind(w) for w in ("idiot", "idiots", "id1ot", "idot", "worthles", "loweix", "idea", "audit")]
    assert kinds == [1, 2, 2, 2, 2, 3, 0, 0]
    k = toxicity._Kinds(lexicon)
    assert toxicity.features("you idiot !", k) == (1.0, 0.0) and toxicity.features('he said "you idiot" loudly', k) == (0.0, 1.0)
    rows = [(i, "this is quite plain talk " * 3 + ("moron " if i % 4 == 0 else "") + f"number {i}", "en", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out)
    assert toxicity.score(odd, toxicity.fit(docs, labels)).count() == len(ODD) and toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_quality(odd, none):
    assert quality.classify(odd).count() == len(ODD) and quality.classify(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    found = langid.op5_language(spark, d).join(common.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    q = quality.op1_quality(spark, d).join(common.table(spark, d, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {r["quality"]: r["k"] for r in q.collect()}
    assert kept[1] > 0.97 and kept[0] < 0.3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_toxicity_errors_anywhere():
    lexicon = toxicity.Lexicon(["idiot", "scum", "disgusting"], ["moron"], {"sum", "moton*"}, ["moronic"])
    kinds = [lexicon.kind(w) for w in ("idoit", "scvm", "sucm", "disgsutnig", "disgutin", "sum")]
    assert kinds == [toxicity.FUZZY] * 5 + [toxicity.NONE]
    # inside a stem, whatever follows, and of a word that the stem stands for
    assert [lexicon.kind(w) for w in ("mroonish", "m0ronic", "motonic", "motonish", "plain")] == [toxicity.FUZZY] * 3 + [toxicity.NONE] * 2


def _distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words, by the plain table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@pytest.mark.parametrize("limit", [200_000, 50])
def test_automaton_equals_plain_distances(limit):
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choices("abcd", k=rng.randint(a, b)))
    terms, stems = {word(3, 12) for _ in range(15)}, {word(4, 8) for _ in range(4)}
    automaton, begins = toxicity.Automaton(terms, stems, limit), frozenset(range(3, 10))
    for _ in range(1500):
        w = list(rng.choice(sorted(terms | stems)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + 2] = rng.choice([w[i : i + 2][::-1], [rng.choice("abcdx")], w[i : i + 2] + ["a"]])
        w = "".join(w) + word(0, 3)
        whole, found = automaton.run(w, begins)
        least = min(((_distance(w, t), t) for t in terms if _distance(w, t) <= (2 if len(t) >= toxicity.LONG else 1)), default=(0, None))[1]
        assert whole == least
        assert found == [(n, min((_distance(w[:n], s), s) for s in stems if _distance(w[:n], s) <= 1)[1]) for n in sorted(begins) if n <= len(w) and any(_distance(w[:n], s) <= 1 for s in stems)]


def test_toxicity_learns_nothing_from_copies(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    copied = [word() for _ in range(60)]
    rows = [(3 * i, " ".join([*copied[:-1], word()]), 1) for i in range(60)]  # near copies of one text
    rows += [(3 * i, " ".join([*(word() for _ in range(20)), "moron"]), 1) for i in range(60, 120)]
    rows += [(3 * i, " ".join(word() for _ in range(20)), 0) for i in range(120, 400)] + [(9000, None, 0), (9001, "", 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    assert [w for w in model.lexicon.words if w in copied] == [] and "moron" in model.lexicon.words + model.lexicon.members + model.lexicon.stems

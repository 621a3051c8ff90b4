"""Sanitisation against a plain scan and plain counts."""

import math
import random
import re

import pytest

from treesync.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and total % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def plain(text):
    found = [(m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    parts = ["a.b@mail.example.com", "x@y.z@q.r.s", "10.0.0.7", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1+23456789012", "9" * 30, "1 2", "é", " ", " ", ".", "-", "kestrel", "\n"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)] + [" ".join(["no.1@mail.example.org 10.1.1.1"] * 700)]


def test_base_spans_like_a_plain_scan(spark, texts):
    out = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", pii.listed(pii.all_spans()).alias("s"), pii.listed(pii.F.col("base")).alias("base"))
    for r in out.collect():
        assert r["base"] == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_many_spans_are_replaced_in_place(spark, texts):
    df = spark.createDataFrame([(0, texts[-1])], "doc_id long, text string")
    assert pii.mask(df).first()["text"] == " ".join(["[EMAIL] [IP]"] * 700)


def test_terms_by_plain_counts(spark):
    """A word far from the entity, and in whichever place, goes; counts are those of whole texts."""
    rng = random.Random(2)
    words = [f"w{''.join(rng.choices('abcdefgh', k=5))}" for _ in range(120)]
    rows = []
    for i in range(300):
        text = rng.sample(words, 40)
        if i % 10 == 0:
            text = ["Merlin", *text, "merlin", f"agent{i}@rare.example.com"] if i % 20 == 0 else [*text, "other@plain.example.com"]
        rows.append((i, " ".join(text)))
    rows.append((300, rows[0][1]))  # a copy proves nothing
    rows.append((301, None))
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    of = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", t or ""))}
    entity = lambda t: {x for m in re.finditer(PATTERNS["email"], t or "") for x in (m[0], m[0].split("@")[1])}
    docs = [(of(t), entity(t), t) for _, t in rows]
    n = len({d[2] for d in docs})
    different = lambda at: len({docs[i][2] for i in at})
    n_e = {e: [i for i, d in enumerate(docs) if e in d[1]] for e in set().union(*(d[1] for d in docs))}
    n_e = {e: at for e, at in n_e.items() if different(at) > 1}
    n_t = {t: different([i for i, d in enumerate(docs) if t in d[0]]) for t in set().union(*(d[0] for d in docs))}
    most = {e: different(at) ** 0.75 * n**0.25 for e, at in n_e.items()}
    held = [d for d in docs if d[1]]
    candidates = {t for t in n_t if 2 <= n_t[t] <= max(most.values()) and len({d[2] for d in held if t in d[0]}) > 1}
    pairs = {}
    for e, at in n_e.items():
        for t in candidates:
            both = different([i for i in at if t in docs[i][0]])
            if both and n_t[t] <= most[e]:
                expected = n_t[t] * different(at) / n
                bits = (both * math.log(both / expected) - both + expected) / math.log(2) + math.log2(1 - math.exp(-expected))
                pairs[e, t] = both, bits if both > 1 and both > expected else 0.0
    good = [b for b in range(1, 1000) if 2.0**-b * len(pairs) <= 0.05 * sum(x >= b for _, x in pairs.values())]
    told = {}
    for (e, t), (both, bits) in pairs.items():
        ic, pmi = math.log2(n / different(n_e[e])), math.log2(n * both / (n_t[t] * different(n_e[e])))
        if good and bits >= min(good) and pmi >= 0.75 * ic:
            told[e, t] = pmi >= 0.95 * ic
    assert ("rare.example.com", "merlin") in told
    for i, (_, text) in enumerate(rows):
        want = {t: max(told[e, t] for e in docs[i][1] if (e, t) in told) for t in docs[i][0] if any((e, t) in told for e in docs[i][1])}
        spans = [(m.start(), m.end(), want[m[0].lower()]) for m in re.finditer(r"[^\W\d_]{3,}", text or "") if m[0].lower() in want]
        assert [(t["start"], t["end"], t["removed"]) for t in out[i]["terms"]] == spans
    shown = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "erlin" not in shown[0] and shown[0].endswith("[EMAIL]") and shown[301] is None and shown[1] == rows[1][1]


def planted(rng, disclosures, strength, holders=8, texts=1500):
    """Texts of common words; each of some mail domains has a word of its own that ``strength`` of its texts have; below 1, so have three texts without an address."""
    words = [f"w{''.join(rng.choices('abcdefghijk', k=6))}" for _ in range(2500)]
    rows = []
    name = lambda d: f"secret{'abcdefghijklmnopqrst'[d % 20]}{'abcdefghijklmnopqrst'[d // 20]}"
    for i in range(texts):
        text, d = rng.sample(words, 60), i // holders
        if strength < 1 and 0 <= i - 2 * disclosures * holders < 3 * disclosures:
            text.insert(7, name((i - 2 * disclosures * holders) // 3))
        if d < disclosures:
            text.insert(rng.randrange(30), f"person{i}@domain{d}.example.com")
            if i % holders < strength * holders:
                text.insert(40, name(d))
        elif d < 2 * disclosures:
            text.insert(rng.randrange(30), f"person{i}@domain{d}.example.com")  # nothing to tell
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("strength", [1.0, 0.75])
def test_planted_disclosures(spark, strength):
    rng = random.Random(int(100 * strength))
    rows = planted(rng, 40, strength)
    out = {r["doc_id"]: r["terms"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    hidden = {(i, m.start()) for i, t in rows if i < 320 for m in re.finditer("secret[a-t]{2}", t)}
    found = {(i, t["start"]) for i, terms in out.items() for t in terms}
    assert len(hidden & found) >= 0.9 * len(hidden) and len(found - hidden) <= 0.1 * len(found)
    # the same spans with copies in the table, of texts with and without disclosures
    copied = rows + [(10_000 + i, rows[j][1]) for i, j in enumerate([0] * 60 + [1, 2, 3, 330, 331] * 20 + list(range(700, 900)))]
    again = {r["doc_id"]: r["terms"] for r in pii.sanitise(spark.createDataFrame(copied, "doc_id long, text string").repartition(4)).collect()}
    assert all(again[i] == out[i] for i in out) and again[10_000] == out[0]
    masked = {r["doc_id"]: r["text"] for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "secret" not in masked[0] and ("[TERM 2^3]" in masked[0]) == (strength < 1)  # nine texts have it: generalised; else removed
    assert strength == 1 or "secret" in masked[640]


def test_many_repeated_texts(spark):
    texts = spark.createDataFrame([(i % 7, "alpha beta" if i % 7 < 3 else "beta gamma") for i in range(70)] + [(100, "alpha")], "text_hash long, text string")
    copies = texts.groupBy("text_hash").count().selectExpr("text_hash", "count AS weight", "count AS copies").where("weight > 1")
    for most in (100, 2):
        out = {r["term"]: r["n"] for r in pii.weighed_words(texts, copies, most).groupBy("term").agg(pii._counted().alias("n")).collect()}
        assert out == {"alpha": 4, "beta": 7, "gamma": 4}

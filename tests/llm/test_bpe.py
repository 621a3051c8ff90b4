"""The encoder and decoder against the library: all code points, random and long texts."""

import hashlib
import random

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from treesync.llm import bpe

POINTS = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    tok.no_padding(), tok.no_truncation()
    return tok


def test_all_code_points(library):
    for i in range(0, len(POINTS), 1 << 14):
        text = " ".join(f"a{c}b" for c in POINTS[i : i + (1 << 14)])
        assert bpe.model().encode(text) == library.encode(text, add_special_tokens=False).ids, hex(ord(POINTS[i]))


def test_random_texts(library):
    rng, pool = random.Random(1), POINTS[:0x600] + [" ", "\n", "\x1c", "Σ", "İ", "'s", "<|endoftext|>", "　", "a", "é", "é"] * 60
    decoder = bpe.Decoder(bpe.model())
    for _ in range(500):
        text = "".join(rng.choices(pool, k=rng.choice([5, 50, 300])))
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.model().encode(text) == ids
        assert "".join(decoder.blocks([ids[:3], [], ids[3:]])) == library.decode(ids, skip_special_tokens=False)


def test_long_texts_in_blocks(spark, library):
    texts = ["x" * 200_000, "word " * 40_000, "é ñ " * 50_000, "中文" * 40_000, "ab ćd " * 12_000 + "<|endoftext|> z"]
    got = {r["doc_id"]: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert max(map(len, bpe.model().blocks(texts[0]))) <= 4 * bpe.LONG
    assert len(list(bpe.parts(texts[1]))) > 3 and "".join(bpe.parts(texts[1])) == texts[1]


def test_bytes_behind_the_names():
    machine = bpe.Decoder(bpe.model(), library=False)
    for text in ("naïve café", "中文 \U0001f600"):
        ids = bpe.model().encode(text)
        assert "".join(machine.blocks([[i] for i in ids])).split() == text.split()


def early(machine, word):
    """(tokens that leave before the last symbol is read, all tokens)"""
    read = 0

    def symbols():
        nonlocal read
        for x in word:
            read += 1
            yield x

    left = [read for _ in machine.encode(symbols())]
    return sum(x < len(word) for x in left), len(left)


def test_random_merge_lists():
    """Also lists that no training gives: rules before those that make their halves, and several rules for one token."""
    rng, ordered = random.Random(3), 0
    for n in range(300):
        suffix, pieces, merges = rng.choice(["", "</w>"]), list("ab"), []
        ends = [x + suffix for x in "ab"] if suffix else []
        for _ in range(rng.randint(1, 14)):
            u, v = rng.choice(pieces), rng.choice(pieces + ends)
            if (u, v) not in merges:
                merges.append((u, v))
                (ends if suffix and v.endswith(suffix) else pieces).append(u + v)
        if n % 3 == 0:
            rng.shuffle(merges)
        machine = bpe.Transducer(merges, suffix)
        ordered += machine.ordered
        for _ in range(30):
            word = "".join(rng.choices("ab", k=rng.randint(1, 40)))
            cut = rng.randint(0, len(word))
            assert list(machine.encode([word[:cut], "", word[cut:]])) == machine.merge([*word[:-1], word[-1] + suffix]), (merges, word)
    assert 30 < ordered < 270


def test_borders_like_plain_merges():
    machine, rng = bpe.model().machine, random.Random(7)
    tokens = [t for t in machine.rule if not t.endswith("</w>")]
    joined = 0
    for before, token in zip(rng.choices(tokens, k=4000), rng.choices(list(machine.rule), k=4000)):
        if machine.fits("", before):
            want = machine.merge([*before, *machine._symbols(token)]) == [before, token]
            assert machine.fits(before, token) == want, (before, token)
            joined += not want
    assert 300 < joined < 3700


def test_tokens_leave_inside_words(spark):
    machine = bpe.model().machine
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = {w for t in texts for w in t.lower().split() if w.isascii() and w.isalpha()}
    counts = [early(machine, w) for w in sorted(words)]
    share = sum(x for x, _ in counts) / sum(n for _, n in counts)
    print(f"{share:.3f} of the tokens of {len(words)} words left early")
    assert share > 0.15  # 0.199 when written
    assert max(len(held) for held, *_ in machine.facts) <= machine.window


def test_states_are_made_anew_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 20)
    machine, rng = bpe.Transducer(list(bpe.model().machine.ranks), "</w>"), random.Random(9)
    for _ in range(200):
        word = "".join(rng.choices("theinrsx", k=rng.randint(1, 60)))
        assert list(machine.encode([word])) == machine.merge([*word[:-1], word[-1] + "</w>"])
        assert len(machine.facts) <= 20

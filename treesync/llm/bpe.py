"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an incremental state machine.

States. Merges run in rank order and, among equals, from the left, so whether a merge crosses the border between two
tokens depends on these two alone: tokens are the encoding of what they spell if and only if each neighbouring pair is
the encoding of what the pair spells. So every prefix of a pre-token has one last token, which is known as soon as the
prefix is read, and the encoding of the prefix is the chain of last tokens that leads there. What follows can only add
tokens that begin at the end of a *live* prefix: the one just read, or one behind which stands the beginning of a longer
token. Live prefixes are the transducer's state, and the tokens that their chains share are final, whatever follows.

Lookahead. How far the shared part may lag behind has a bound that the merge list alone decides. Run the merges in rank
order over a prefix w and over w followed by anything. Both agree up to a frontier, at first the end of w. It moves left
only when a rule (u, v) merges across it: u is then the last agreed token, and v begins right behind it. After that the
token behind the frontier begins with u. So a run of moves is a chain of rules of growing rank in which each u lies on
the left spine of the next rule's v, and no chain can move the frontier by more than the greatest sum of len(u) along
one. ``lookahead`` computes that number. A live prefix ends less than the longest token before what has been read, so no
more than both lengths together is ever held.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, table

#: Most entries of a worker's cache of encoded chunks, and the longest chunk that it keeps.
CACHE_ROWS, CACHE_LENGTH = 250_000, 24
#: States of the transducer that a worker keeps; when there are more, all are made anew.
STATES = 400_000
#: Chunks lie between white space; ``str.split`` agrees with the tokenizer but for four control characters.
SPACE, CONTROL = regex.compile(r"\s+"), re.compile(r"[\x1c-\x1f]")
#: Code points of a part of a text, and where it may be cut; longer chunks than LONG are encoded in blocks.
PART, CUT, LONG = 1 << 16, re.compile(r"[\t\n\r ](?=[!-~])"), 4096


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, following = [], 0x100
    for b in range(256):
        out.append(chr(b if b in shown else following))
        following += b not in shown
    return out


def lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols behind a token's end after which it can't change (see above)."""
    size = lambda t: len(t[: -len(suffix)]) if suffix and t.endswith(suffix) else len(t)
    left = {u + v: u for u, v in reversed(merges)}
    reach: dict[str, int] = {}  # most that chains of later rules move, by a token on the left spine of their first v
    most = 0
    for u, v in reversed(merges):
        moved = size(u) + reach.get(u, 0)
        most = max(most, moved)
        on: str | None = v
        while on is not None and reach.get(on, 0) < moved:
            reach[on] = moved
            on = left.get(on)
    return most


class Transducer:
    """Encodes one pre-token given in parts.

    A state depends on the token that left last and on what was read since, at most ``window`` symbols. States and moves
    are made when first met and kept up to a bound; they are tuples, which garbage collection passes over.
    """

    def __init__(self, merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.suffix = suffix
        self.rule = {u + v: (u, v, i) for i, (u, v) in enumerate(merges)}
        made = lambda t: self.rule.get(t, (t, t, -1))[2]
        #: One rule makes each token, after those that make its halves: so merges run in order of rank.
        self.ordered = len(self.rule) == len(merges) and all(max(made(u), made(v)) < i for i, (u, v) in enumerate(merges))
        spelt = [t.removesuffix(suffix) if suffix else t for t in self.rule]
        self.known = dict.fromkeys((t[:k] for t in spelt for k in range(1, len(t))), 1)  # what a longer token begins with
        for t in self.rule:
            self.known[t] = self.known.get(t, 0) + 2
        self.partners: dict[str, dict[str, int]] = {}  # ranks by left and right side
        for (u, v), i in self.ranks.items():
            self.partners.setdefault(u, {})[v] = i
        self.rims: tuple[dict[str, tuple[tuple[str, int], ...]], ...] = ({}, {})  # of beginnings and of ends, see ``_rim``
        self.longest = max(map(len, spelt), default=1)
        self.ahead = lookahead(merges, suffix)
        self.window = self.ahead + self.longest
        self._forget()

    def _forget(self) -> None:
        """Begin with the first state only: (held, last, back, live).

        ``last[i]`` is the last token of the first i symbols held (of none: the token that left last), ``back[i]`` where it
        begins, and ``live`` has the ends of the live prefixes.
        """
        self.facts, self.states = [("", ("",), (0,), (0,))], {("", ""): 0}
        self.moves: dict[tuple[int, str], tuple[int, tuple[str, ...]]] = {}  # by state and next symbol: state, tokens that leave
        self.ends: dict[tuple[int, str], tuple[str, ...]] = {}  # by state and last symbol

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the pair of lowest rank first, leftmost among equals."""
        get, none = self.ranks.get, len(self.ranks)
        ranks = list(map(get, zip(symbols, symbols[1:], strict=False), repeat(none)))
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if not self.suffix or not token.endswith(self.suffix):
            return list(token)
        spelt = token.removesuffix(self.suffix)
        return [*spelt[:-1], spelt[-1:] + self.suffix]

    def fits(self, before: str, token: str) -> bool:
        """Whether the two are the encoding of what they spell (behind nothing: whether the token is); ``before`` is one of itself.

        A rule merges across the border if both its sides stand there when its turn comes: among the right ends of ``before``
        and the left beginnings of ``token``, neither yet merged away from the border. Of equal rules the left one is first.
        """
        begins = self.rims[0].get(token)
        if begins is None:
            begins = self.rims[0][token] = self._rim(token, 0) if self.merge(self._symbols(token)) == [token] else ()
        if not begins or not before:
            return bool(begins)
        if not self.ordered:
            return self.merge([*before, *self._symbols(token)]) == [before, token]
        ends = self.rims[1].get(before)
        if ends is None:
            ends = self.rims[1][before] = self._rim(before, 1)
        for u, u_until in ends:
            ranks = self.partners.get(u)
            if ranks:
                for v, v_until in begins:
                    rank = ranks.get(v)
                    if rank is not None and rank < u_until and rank <= v_until:
                        return False
        return True

    def _rim(self, token: str, side: int) -> tuple[tuple[str, int], ...]:
        """What stands at an end of a token while it is made (side 0: its beginning), and the rank of the rule that merges it away."""
        out, part, until = [], token, len(self.ranks)
        while part:
            out.append((part, until))
            rule = self.rule.get(part)
            part, until = (rule[side], rule[2]) if rule else ("", 0)
        return tuple(out)

    def _step(self, state: int, symbol: str) -> tuple[int, tuple[str, ...]]:
        """The state after one more symbol, and the tokens that are stable then."""
        held, last, back, live = self.facts[state]
        held += symbol
        size, known = len(held), self.known.get
        token, begin, kept = symbol, size - 1, []
        for start in live:
            piece = held[start:]
            kind = known(piece)
            if kind:
                if kind != 2:
                    kept.append(start)
                if kind > 1 and token is symbol and self.fits(last[start], piece):  # no other does
                    token, begin = piece, start
        kept.append(size)
        last, back, shared, out = (*last, token), (*back, begin), kept[0], ()
        if shared:
            for x in kept:  # where the part that the chains of all live prefixes share ends
                while x != shared:
                    if x > shared:
                        x = back[x]
                    else:
                        shared = back[shared]
            if shared:
                out, held, last = _chain(last, back, shared), held[shared:], last[shared:]
                back, kept = tuple([x - shared for x in back[shared:]]), [x - shared for x in kept]
        live = tuple(kept)
        if len(self.facts) >= STATES:
            self._forget()  # the state left behind is gone, so this move isn't kept
            state = -1
        following = self.states.setdefault((last[0], held), len(self.facts))
        if following == len(self.facts):
            self.facts.append((held, last, back, live))
        if state >= 0:
            self.moves[state, symbol] = following, out
        return following, out

    def _end(self, state: int, symbol: str) -> tuple[str, ...]:
        """The tokens that are left when the symbol is the last one."""
        held, last, back, live = self.facts[state]
        held += symbol
        token, begin = symbol + self.suffix, len(held) - 1
        for start in live:
            piece = held[start:] + self.suffix
            if self.known.get(piece, 0) > 1 and self.fits(last[start], piece):
                token, begin = piece, start
                break
        out = self.ends[state, symbol] = (*_chain(last, back, begin), token)
        return out

    def encode(self, parts: Iterable[str]) -> Iterator[str]:
        """Tokens of the concatenated parts, each as soon as it is stable; the last symbol carries the suffix. One at a time."""
        if len(self.ends) >= STATES:
            self._forget()
        state, waiting = 0, ""
        for part in filter(None, parts):
            for symbol in waiting + part[:-1]:
                state, out = self.moves.get((state, symbol)) or self._step(state, symbol)
                if out:
                    yield from out
            waiting = part[-1]
        if waiting:
            yield from self.ends.get((state, waiting)) or self._end(state, waiting)


def _chain(last: tuple[str, ...], back: tuple[int, ...], end: int) -> tuple[str, ...]:
    """The tokens of the prefix that ends there."""
    out = []
    while end > 0:
        out.append(last[end])
        end = back[end]
    return tuple(out[::-1])


class _Memo(dict):
    """Values by short keys, made when missing. When full it becomes the old generation, from which keys in use come back."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_ROWS:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


# What Unicode assigned after the tokenizer's version, as hexadecimal code points.
# Letters and numbers that the tokenizer's patterns don't know:
UNKNOWN = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168
1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Lower case that the tokenizer knows and Python 3.13 doesn't (first-last:lower case of the first):
LOWER = "1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def _points(ranges: str) -> Iterator[tuple[int, int, int]]:
    """(code point, its place in its range, what the range is mapped to or 0)."""
    for r in ranges.split():
        span, _, to = r.partition(":")
        first, _, last = span.partition("-")
        for c in range(int(first, 16), int(last or first, 16) + 1):
            yield c, c - int(first, 16), int(to or "0", 16)


class WordBpe:
    """The word-end vocabulary: NFC, lower case, white space dropped, byte letters, merges, special tokens found in raw text.

    Ids travel as bytes of native unsigned 32-bit numbers.
    """

    def __init__(self, tokenizer_json: str | None = None) -> None:
        import public_tokenizers

        with open(tokenizer_json or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.machine = Transducer([tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]], self.suffix)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.unknown = {c: 0x10FFFF for c, _, _ in _points(UNKNOWN)}  # a noncharacter instead
        self.lower = {c: to + i for c, i, to in _points(LOWER)}
        self.capitals = frozenset(map(chr, self.lower))
        self.late = re.compile(f"[^\0-{chr(min([*self.unknown, *self.lower]) - 1)}]")  # a quick test that most texts don't pass
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        self.chunk = _Memo(self._chunk)

    def _letters(self, piece: str, size: int = 4096) -> Iterator[str]:
        for i in range(0, len(piece), size):
            yield piece[i : i + size].encode("utf-8", "replace").decode("latin-1").translate(self.letters)

    def _ids(self, piece: str) -> Iterator[int]:
        """The ids of one pre-token, each as soon as it is stable."""
        plain = len(piece) <= CACHE_LENGTH and piece.isascii() and piece.isprintable()  # its own byte letters, in one part
        return map(self.vocab.__getitem__, self.machine.encode([piece] if plain else self._letters(piece)))

    def _split(self, chunk: str) -> Iterator[str]:
        shape = chunk if chunk.isascii() or not self.late.search(chunk) else chunk.translate(self.unknown)
        return (chunk[m.start() : m.end()] for m in self.pieces.finditer(shape))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what lies between white space; a pre-token by itself is a chunk too, so both share the cache."""
        if not (chunk.isascii() and chunk.isalpha()):
            pieces = list(self._split(chunk))
            if pieces != [chunk]:
                return b"".join([self.chunk[x] for x in pieces])
        return array("I", self._ids(chunk)).tobytes()

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        if self.late.search(text) and not self.capitals.isdisjoint(text):
            text = text.translate(self.lower)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma

    def _plain(self, text: str) -> Iterator[bytes]:
        """Blocks of ids of a text without special tokens."""
        text = self.normal(text)
        chunks = SPACE.split(text) if CONTROL.search(text) else text.split()
        if max(map(len, chunks), default=0) <= LONG:
            yield b"".join(map(self.chunk.__getitem__, chunks))
            return
        for chunk in chunks:
            if len(chunk) <= LONG:
                yield self.chunk[chunk]
                continue
            for piece in self._split(chunk):
                ids = iter(self._ids(piece))
                while block := array("I", islice(ids, LONG)).tobytes():
                    yield block

    def blocks(self, text: str) -> Iterator[bytes]:
        """Blocks of the ids of a text, which is read in parts of about ``PART`` code points; what is held doesn't grow with the text's ids."""
        for part in parts(text):
            if not any(s in part for s in self.special):
                yield from self._plain(part)
                continue
            for piece in self.marks.split(part):
                if piece in self.special:
                    yield array("I", [self.special[piece]]).tobytes()
                else:
                    yield from self._plain(piece)

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(self.blocks(text))).tolist()


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Cuts before white space that printable ASCII follows: no composition, pre-token or special token reaches across."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Decoder:
    """ids -> text by an incremental machine: each id gives bytes, and an incremental UTF-8 decoder gives text and holds back an unfinished character.

    With ``library`` the bytes of an id are those of its name, names joined by one space, as the library does for
    vocabularies without a decoder. Without, they are the bytes behind the name's byte letters, with a space for every word end.
    """

    def __init__(self, bpe: WordBpe, library: bool = True) -> None:
        byte = {x: b for b, x in enumerate(byte_letters())}
        self.library, special = library, set(bpe.special.values())

        def raw(i: int, name: str) -> bytes:
            if library or i in special:
                return (" " * library + name).encode()
            ends = bool(bpe.suffix) and name.endswith(bpe.suffix)
            return bytes(byte[c] for c in (name.removesuffix(bpe.suffix) if ends else name)) + b" " * ends

        self.bytes = {i: raw(i, name) for i, name in bpe.names.items()}

    def blocks(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """The text of blocks of ids, as far as it is known after each."""
        state, first = codecs.getincrementaldecoder("utf-8")("replace"), self.library
        for block in ids:
            raw = b"".join(map(self.bytes.__getitem__, block))
            yield state.decode(raw[1:] if first and raw else raw)
            first = first and not raw
        yield state.decode(b"", True)


_MODELS: dict[str | None, WordBpe] = {}


def model(tokenizer_json: str | None = None) -> WordBpe:
    """One model per worker process."""
    if tokenizer_json not in _MODELS:
        _MODELS[tokenizer_json] = WordBpe(tokenizer_json)
    return _MODELS[tokenizer_json]


def _digests(tokenizer_json: str | None):
    def digest(bpe: WordBpe, decoder: Decoder, decimal: Callable[[int], str], text: str) -> tuple[int, str, str]:
        n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()

        def ids() -> Iterator[list[int]]:
            nonlocal n
            for block in bpe.blocks(text):
                numbers = array("I", block).tolist()
                if numbers:
                    ids_sha.update((" " * (n > 0) + " ".join(map(decimal, numbers))).encode())
                    n += len(numbers)
                yield numbers

        for known in decoder.blocks(ids()):
            text_sha.update(known.encode("utf-8", "replace"))
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_json)
        decoder, decimal = Decoder(bpe), {i: str(i) for i in bpe.names}.__getitem__
        for batch in batches:
            rows = [digest(bpe, decoder, decimal, text or "") for text in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(tokenizer_json: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_json)
        for batch in batches:
            ids = [bpe.encode(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoded(tokenizer_json: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [Decoder(model(tokenizer_json), library) for library in (True, False)]
        for batch in batches:
            rows = [x or [] for x in batch.column(1).to_pylist()]
            both = [["".join(m.blocks([ids])) for ids in rows] for m in machines]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in both)], ["doc_id", "decoded", "text"])

    return run


def _slim(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer_json: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text. Null and empty texts give no ids; rows that repeat are encoded each by itself; other columns are not read."""
    return _slim(docs).mapInArrow(_encoded(tokenizer_json), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_json: str | None = None) -> DataFrame:
    """doc_id, decoded (as the tokenizers library decodes), text (the bytes as UTF-8, a space after each word) of ``encoded(doc_id, ids)``; null ids count as none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(tokenizer_json), "doc_id long, decoded string, text string")


def digests(docs: DataFrame, tokenizer_json: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, in one narrow pass.

    Ids go block by block from the encoder into a digest and through the decoder into the other, so a very long text needs
    no more memory than its own. Nulls and repeated rows as in ``encode``; an empty table gives no rows.
    """
    return _slim(docs).mapInArrow(_digests(tokenizer_json), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids and of the decoded text of all documents; odd rows as in ``digests``."""
    return digests(table(spark, sf_dir, "documents"))

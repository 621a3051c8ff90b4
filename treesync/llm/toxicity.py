"""Toxicity from a learnt lexicon, found in spite of misspellings, and weighed by context.

Lexicon: words and word beginnings (stems) of toxic learning rows that other learning rows hardly have. A word is matched by
the Levenshtein automaton of that word, simulated with one bit mask of states per number of errors, which is run
over the trie of the lexicon at once for all terms; a swap of neighbours is one error. Any term may have one error, long
ones two, and a word may begin with a stem that has one. A window around each hit tells quotation from abuse: hits between
quotation marks count apart. A logistic model of the two kinds of hits gives the score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, stage, table
from treesync.llm.langid import held_out, learning

NONE, EXACT, FUZZY, STEM = 0, 1, 2, 3
#: What a hit of each kind counts; a misspelling less where other rows have that term's misspellings too.
WEIGHT = (0.0, 1.0, 0.8, 1.0)
OPENING, CLOSING = tuple("\"'“«„‘‹"), tuple("\"'”»“’›")
EDGE = ".,;:!?()[]{}<>\"'“”«»„‘’‹›…|%&$*#@-_/\\"
CACHE_ROWS = 200_000
#: Terms from this length on may have two errors.
LONG = 9


class State(dict):
    """What may still become a term after the letters read so far; as a dictionary, the state behind each next letter, filled when first needed.

    ``positions`` holds (node, letter owed by a swap or None): errors so far. ``whole`` is the closest term that the letters read are,
    ``begin`` the closest stem; each the one of fewest errors, then the least. ``notable``: a stem ends here, or no term is within reach.
    """

    __slots__ = ("automaton", "positions", "whole", "begin", "notable")

    def __missing__(self, letter: str) -> State:
        return self.automaton.step(self, letter)


class Automaton:
    """The trie of a lexicon intersected with the Levenshtein automata of all its terms, made deterministic state by state as words need it.

    Words of one beginning share its states, and a word is left as soon as no term is within reach. States are dropped
    altogether when there are ``limit`` transitions, so memory is bounded.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str], limit: int = 200_000) -> None:
        self.children: list[dict[str, int]] = []
        self.allowed: list[int] = []
        self.whole: dict[int, str] = {}
        self.begin: dict[int, str] = {}
        self.limit = limit
        terms = set(terms)
        tries = ((1, [w for w in terms if len(w) < LONG], self.whole), (2, [w for w in terms if len(w) >= LONG], self.whole), (1, set(stems), self.begin))
        self.roots = [self._trie(*t) for t in tries]
        self._reset()

    def _trie(self, errors: int, words: Iterable[str], ends: dict[int, str]) -> int:
        root = self._node(errors)
        for w in words:
            node = root
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = self._node(errors)
                node = self.children[node][c]
            ends[node] = w
        return root

    def _node(self, errors: int) -> int:
        self.children.append({})
        self.allowed.append(errors)
        return len(self.children) - 1

    def _reset(self) -> None:
        self.states: dict[frozenset, State] = {}
        self.steps = 0
        self.dead = self._state({})
        self.start = self._state({(r, None): 0 for r in self.roots if self.children[r]})

    def _state(self, positions: dict[tuple[int, str | None], int]) -> State:
        # letters of a term that the word leaves out
        todo = list(positions.items())
        while todo:
            (node, owed), e = todo.pop()
            if owed is None and e < self.allowed[node]:
                for child in self.children[node].values():
                    if positions.get((child, None), 9) > e + 1:
                        positions[child, None] = e + 1
                        todo.append(((child, None), e + 1))
        key = frozenset(positions.items())
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State()
            state.automaton, state.positions = self, positions
            ends = [(e, node) for (node, owed), e in positions.items() if owed is None]
            state.whole = min(((e, self.whole[n]) for e, n in ends if n in self.whole), default=(0, None))[1]
            state.begin = min(((e, self.begin[n]) for e, n in ends if n in self.begin), default=(0, None))[1]
            state.notable = state.begin is not None or not positions
        return state

    def step(self, state: State, letter: str) -> State:
        out: dict[tuple[int, str | None], int] = {}

        def reach(node: int, owed: str | None, e: int) -> None:
            if out.get((node, owed), 9) > e:
                out[node, owed] = e

        for (node, owed), e in state.positions.items():
            children = self.children[node]
            if owed is not None:
                if letter == owed:
                    reach(node, None, e)
                continue
            if letter in children:
                reach(children[letter], None, e)
            if e < self.allowed[node]:
                reach(node, None, e + 1)
                for c, child in children.items():
                    reach(child, None, e + 1)
                    if c != letter and letter in self.children[child]:
                        reach(self.children[child][letter], c, e + 1)
        if self.steps >= self.limit:
            self._reset()
        self.steps += 1
        state[letter] = found = self._state(out)
        return found

    def run(self, word: str, begins: frozenset[int]) -> tuple[str | None, list[tuple[int, str]]]:
        """The term that is close to the word, and, for beginnings of the given lengths, the stems close to them."""
        state, found = self.start, []
        for n, c in enumerate(word, 1):
            state = state[c]
            if state.notable:
                if not state.positions:
                    return None, found
                if n in begins:
                    found.append((n, state.begin))
        return state.whole, found

    def __reduce__(self):
        terms = self.whole.values()
        return Automaton, (sorted(terms), sorted(self.begin.values()), self.limit)


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    benign: set[str] = field(default_factory=set)  # close to a term, yet usual in rows that aren't toxic; beginnings close to a stem end in *
    members: list[str] = field(default_factory=list)  # words that a stem stands for
    weights: dict[str, float] = field(default_factory=dict)  # what a misspelling of a term or stem (with *) counts

    def __post_init__(self) -> None:
        self.exact = set(self.words)
        self.by_size = {n: {s for s in self.stems if len(s) == n} for n in {len(s) for s in self.stems}}
        self.automaton = Automaton([*self.words, *self.members], self.stems)
        self.begins = frozenset(n + d for n in self.by_size for d in (-1, 0, 1))

    def close(self, word: str) -> list[tuple[str, str]]:
        """What of the word is close to which term: all of it to a term, or beginnings of it (with *) to a stem, with anything behind."""
        whole, begins = self.automaton.run(word, self.begins)
        return [(word, whole)] * (whole is not None) + [(word[:n] + "*", stem + "*") for n, stem in begins]

    def hit(self, word: str) -> tuple[int, float]:
        """Kind of hit and what it counts."""
        whole, begins = self.automaton.run(word, self.begins)
        if whole is None and not begins:
            return NONE, 0.0
        if word in self.exact:
            return EXACT, WEIGHT[EXACT]
        if any(word[:n] in stems for n, stems in self.by_size.items()):
            return STEM, WEIGHT[STEM]
        if word in self.benign:
            return NONE, 0.0
        found = [] if whole is None else [whole]
        if not any(word[:n] + "*" in self.benign for n, _ in begins):
            found += [stem + "*" for _, stem in begins]
        if not found:
            return NONE, 0.0
        return FUZZY, max(self.weights.get(term, WEIGHT[FUZZY]) for term in found)

    def kind(self, word: str) -> int:
        return self.hit(word)[0]


class _Kinds(dict):
    """What each chunk of text counts as a hit."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon

    def __missing__(self, chunk: str) -> float:
        out = self.lexicon.hit(chunk.strip(EDGE))[1]
        if len(chunk) < 32:
            if len(self) >= CACHE_ROWS:
                self.clear()
            self[chunk] = out
        return out


def quoted(words: list[str], at: int, window: int) -> bool:
    """Whether quotation marks open before and close behind the word within the window."""

    def opens() -> bool:
        for k in range(at, max(-1, at - window), -1):
            if words[k].startswith(OPENING):
                return True
            if k < at and words[k].rstrip(".,;:!?").endswith(CLOSING):
                return False
        return False

    return opens() and any(words[k].rstrip(".,;:!?").endswith(CLOSING) for k in range(at, min(len(words), at + window)))


def features(text: str | None, kinds: _Kinds, window: int = 12) -> tuple[float, float]:
    """Weighed hits outside and inside of quotation."""
    words = (text or "").lower().split()
    found = list(map(kinds.__getitem__, words))
    if not any(found):
        return 0.0, 0.0
    direct = inside = 0.0
    for at, weight in enumerate(found):
        if weight:
            if quoted(words, at, window):
                inside += weight
            else:
                direct += weight
    return direct, inside


def design(direct: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(direct)), np.minimum(direct, 1), np.log1p(direct), np.log1p(inside)], axis=1).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton's method, of rows with weights."""
    w, n = np.zeros(x.shape[1]), weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x / n + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) / n + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


#: Letters of a word that may be a term, and of a stem. Shorter words are close to too many others for a search with errors.
WORD_LETTERS, STEM_LETTERS = (3, 40), (4, 8)


def _terms(word: str) -> list[str]:
    """The word and, with *, its beginnings."""
    return [word, *(word[:n] + "*" for n in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(word)) + 1))] if WORD_LETTERS[0] <= len(word) <= WORD_LETTERS[1] else []


class _Terms(dict):
    """The allowed terms of each chunk of text; without a set of allowed ones, all."""

    def __init__(self, allowed: frozenset | None) -> None:
        self.allowed = allowed

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        out = tuple(t for t in _terms(chunk.strip(EDGE)) if self.allowed is None or t in self.allowed)
        if len(self) >= CACHE_ROWS:
            self.clear()
        self[chunk] = out
        return out


def _count(allowed):
    """Weights of the rows with each term, partial sums by task; among given terms only, or all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, float] = defaultdict(float)
        terms = _Terms(allowed and allowed.value)
        frame = lambda: pd.DataFrame({"term": list(seen.keys()), "rows": list(seen.values())}).astype({"term": "object", "rows": "float64"})
        for batch in batches:
            for text, weight in zip(batch["text"], batch["weight"], strict=True):
                for term in set(chain.from_iterable(map(terms.__getitem__, set((text or "").lower().split())))):
                    seen[term] += weight
            if len(seen) > 300_000:
                yield frame()
                seen.clear()
        yield frame()

    return run


def _features(lexicon):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = _Kinds(lexicon.value)
        for batch in batches:
            both = [features(t, kinds) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "weight": batch["weight"], "direct": [b[0] for b in both], "inside": [b[1] for b in both]})

    return run


def _fuzzy(lexicon):
    """Weights of the rows of each label with each part of a word that is close to a term, by that term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, float] = defaultdict(float)
        close: dict[str, list] = {}
        for batch in batches:
            for text, toxic, weight in zip(batch["text"], batch["toxic"], batch["weight"], strict=True):
                words = {c.strip(EDGE) for c in (text or "").lower().split()}
                for w in words.difference(close):
                    near = lexicon.value.close(w)
                    close[w] = near if near and lexicon.value.kind(w) == FUZZY else ()
                for found in {(*x, toxic) for w in words for x in close[w]}:
                    seen[found] += weight
                if len(close) > CACHE_ROWS:
                    close.clear()
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["part", "term", "toxic", "rows"]).astype({"part": "object", "term": "object", "toxic": "int32", "rows": "float64"})

    return run


#: Bands of least hashes; two texts are taken as near copies if they agree in all hashes of a band.
BANDS, BAND_HASHES = 4, 3


def _marked(rows: DataFrame) -> DataFrame:
    """Add marks of each text, from least hashes of its sequences of five words: texts that nearly agree (0.75) share a mark with a chance of 0.89, of those that share a third of them one in eight does."""
    words = F.split(F.trim(F.lower("text")), r"\s+")
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, F.lit(5))))
    least = lambda k: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, F.lit(k))))
    marks = [F.xxhash64(*(least(BAND_HASHES * b + k) for k in range(BAND_HASHES))).alias(f"mark{b}") for b in range(BANDS)]
    return rows.withColumn("words", words).withColumn("hashes", hashes).select("doc_id", "text", "toxic", *marks)


def _groups(rows: pd.DataFrame, marks: list[str]) -> np.ndarray:
    """The group of each row: rows that share a mark, and rows that share one with those."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for mark in marks:
        first: dict[tuple, int] = {}
        for i, key in enumerate(zip(rows["toxic"], rows[mark], strict=True)):
            a, b = find(first.setdefault(key, i)), find(i)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(rows))], np.int64)


def _weighed(sample: DataFrame) -> DataFrame:
    """text, toxic and weight: one over the rows of the group of copies and near copies, within a label: a word is no term because many copies of one text have it, however many groups there are."""
    marks = [f"mark{b}" for b in range(BANDS)]
    rows = sample.select("doc_id", "toxic", *marks).toPandas()  # of the bounded sample
    groups = _groups(rows, marks)
    weights = rows[["doc_id"]].assign(weight=1.0 / np.bincount(groups, minlength=len(rows))[groups]).drop_duplicates("doc_id")
    weights = sample.sparkSession.createDataFrame(weights, "doc_id long, weight double")
    return stage(sample.join(F.broadcast(weights), "doc_id").select("text", "toxic", "weight"), "toxicity-learning")


def evidence(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratios G^2 of terms that a of n1 toxic and b of n0 other rows have; 0 where toxic rows have them no more often."""
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    share = (a + b) / (n1 + n0)
    g = 2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share)))
    return np.where(a * n0 > b * n1, g, 0.0)


def chance(g: float) -> float:
    """The chance that a term without any relation to the label has a G^2 of ``g`` or more with toxic rows ahead: half the chi-square law of one degree."""
    return erfc(sqrt(g / 2)) / 2 if g > 0 else 1.0


def told_apart(chances: dict[str, float], candidates: int, error: float) -> set[str]:
    """The terms that a test of all ``candidates`` together accepts, of which a share of ``error`` at most is expected to be chance (Benjamini and Hochberg); ``chances`` has the candidates of small chance."""
    ranked = sorted(chances, key=lambda t: (chances[t], t))
    good = [k for k, t in enumerate(ranked, 1) if chances[t] <= k * error / max(candidates, 1)]
    return set(ranked[: good[-1]]) if good else set()


def lexicon_terms(often: dict[str, float], rare: dict[str, float], n1: float, n0: float, candidates: int, purity: float, error: float) -> tuple[list[str], list[str], list[str]]:
    """(words, stems, members) from the weights of toxic and other rows with each word and each ``stem*``.

    A term must be told from chance among all ``candidates``, with a share of ``error`` of wrong ones, and be ``purity`` times as
    frequent in toxic rows. A stem also needs two words under it that are as pure and told from chance among those under it, and more evidence
    than any of them. Words under a stem are its members.
    """
    names = sorted(often)
    a, b = np.array([often[t] for t in names]), np.array([rare.get(t, 0.0) for t in names])
    pure = {t for t, ok in zip(names, (a + 0.5) / (n1 + 1) >= purity * (b + 0.5) / (n0 + 1), strict=True) if ok}
    score = dict(zip(names, evidence(a, b, n1, n0).tolist(), strict=True))
    chances = {t: chance(g) for t, g in score.items()}
    strong = told_apart(chances, candidates, error) & pure
    below: dict[str, list[str]] = {t[:-1]: [] for t in strong if t.endswith("*")}
    for w in names:
        if not w.endswith("*"):
            for n in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(w)) + 1):
                if w[:n] in below:
                    below[w[:n]].append(w)
    several = {s for s, ws in below.items() if len(told_apart({w: chances[w] for w in ws}, len(ws), error) & pure) >= 2 and score[s + "*"] > max(score[w] for w in ws)}
    stems = sorted(s for s in several if not any(s[:n] in several for n in range(STEM_LETTERS[0], len(s))))
    words = {t for t in strong if not t.endswith("*")}
    members = {w for s in stems for w in below[s] if w in words}
    return sorted(words - members), stems, sorted(members)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 4000, other_rows: int = 12000, least_share: float = 0.005, purity: float = 50.0, error: float = 0.05) -> Model:
    """Learn from labelled rows that aren't held out; of each label about so many rows, chosen by a hash of the id.

    Each row weighs one over the size of its group of copies and near copies in the sample; where even a term that all groups of
    toxic rows have and no other could not be told from chance, so few are they, rows weigh one each. Terms are what ``lexicon_terms`` tells from
    chance, among those that at least ``least_share`` of the toxic weight has. Labels other than 0 and 1 are not used; of labels
    that repeat for an id, the greatest counts.
    """
    spark = docs.sparkSession
    marked = labels.where(learning(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    none = Model(Lexicon([], []), np.array([-3.0, 0.0, 0.0, 0.0]))
    if not totals.get(1) or not totals.get(0):
        return none
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = marked.where(share < F.when(F.col("toxic") == 1, toxic_rows / totals[1]).otherwise(other_rows / totals[0]))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # bounded by toxic_rows + other_rows
    sample = _weighed(stage(_marked(sample), "toxicity-sample"))
    total = lambda df, f: df.select("text", "weight").mapInPandas(f, "term string, rows double").groupBy("term").agg(F.sum("rows").alias("n"))
    while True:
        sizes = {r["toxic"]: r["w"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
        if len(sizes) < 2:
            return none
        n1, n0 = sizes[1], sizes[0]
        found = stage(total(sample.where("toxic = 1"), _count(None)), "toxicity-terms")
        candidates = found.count()
        best = chance(float(evidence(np.array([n1]), np.array([0.0]), n1, n0)[0]))
        if best <= error / max(candidates, 1) or sample.where("weight < 1").isEmpty():
            break
        sample = sample.withColumn("weight", F.lit(1.0))
    often = {r["term"]: r["n"] for r in found.where(F.col("n") >= least_share * n1).collect()}
    rare = {r["term"]: r["n"] for r in total(sample.where("toxic = 0"), _count(spark.sparkContext.broadcast(frozenset(often)))).collect()}
    words, stems, members = lexicon_terms(often, rare, n1, n0, candidates, purity, error)
    lexicon = Lexicon(words, stems, members=members)
    parts = sample.mapInPandas(_fuzzy(spark.sparkContext.broadcast(lexicon)), "part string, term string, toxic int, rows double")
    parts = parts.groupBy("part", "term", "toxic").agg(F.sum("rows").alias("n")).collect()  # of the bounded sample
    benign = {r["part"] for r in parts if not r["toxic"] and r["n"] > 1}
    # a term's misspellings count by how seldom other rows have them
    by_label: tuple[dict, dict] = (defaultdict(float), defaultdict(float))
    for r in parts:
        if r["part"] not in benign:
            by_label[r["toxic"]][r["term"]] += r["n"]
    weights = {t: WEIGHT[FUZZY] * (by_label[1][t] + 1) / (by_label[1][t] + by_label[0][t] + 1) for t in {r["term"] for r in parts}}
    lexicon = Lexicon(words, stems, benign, members, weights)
    rows = sample.mapInPandas(_features(spark.sparkContext.broadcast(lexicon)), "toxic int, weight double, direct double, inside double").toPandas()
    weights = logistic(design(rows["direct"].to_numpy(), rows["inside"].to_numpy()), rows["toxic"].to_numpy(float), rows["weight"].to_numpy())
    # the weights' rates back to those of all labelled rows
    weights[0] += np.log(totals[1] / totals[0]) - np.log(n1 / n0)
    return Model(lexicon, weights)


_KINDS: dict[int, _Kinds] = {}


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.id not in _KINDS:
            _KINDS.clear()
            _KINDS[model.id] = _Kinds(model.value.lexicon)
        kinds = _KINDS[model.id]
        for batch in batches:
            both = np.array([features(t, kinds) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(design(both[:, 0], both[:, 1]) @ model.value.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


class _Shared:
    """A broadcast model and a number for it, by which a worker keeps what it derives."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state) -> None:
        self.broadcast, self.id = state

    @property
    def value(self) -> Model:
        return self.broadcast.value


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every whole text of ``docs(doc_id, text, ...)``, in one narrow pass.

    Null and empty texts have no hits and get the score of such a text. Repeated rows are scored each by itself, an empty table
    gives no rows, and other columns are not read. Without labels of both kinds nothing is toxic. Of terms equally close to a word the
    least one counts. Words are what stands between blanks: a text of a script without blanks is one long word, which no term is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_score(_Shared(spark.sparkContext.broadcast(model)), threshold), "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model of the labelled ones; odd rows as in ``score`` and ``fit``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

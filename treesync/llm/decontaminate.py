"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are maximal runs of digits, letters a to z (A to Z are lower-cased) and anything beyond ASCII. Normalising maps byte to
byte, so places in the normalised text are places in the original. The automaton runs over word numbers, ten states a window at
most; a text passes once, in pieces, with the automaton's state carried over, so memory doesn't grow with a text.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, stage, table

#: Windows of one automaton: some 300 MB of states in a worker. A larger benchmark is cut into blocks of items, with a scan for each.
MOST_WINDOWS = 400_000
#: Bytes of text that are split into words at once.
PIECE = 1 << 20
#: Each byte as it is normalised: letters in lower case, separators as blanks.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(raw: bytes, size: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(offset, normalised bytes) of parts that end between words, but for words longer than a part."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        part = raw[at:end].translate(NORMAL)
        while end < len(raw):
            cut = part.rfind(b" ")
            if cut >= 0:
                part = part[: cut + 1]
                break
            more = raw[end : end + size].translate(NORMAL)
            end += len(more)
            part += more
        yield at, part
        at += len(part)


def windows(words: list[bytes], width: int = 10) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``width`` words; all words where there are fewer, but some."""
    for i in range(max(min(len(words), 1), len(words) - width + 1)):
        yield tuple(words[i : i + width])


class Automaton:
    """Windows of items, by the numbers of their words; 0 stands for words that no window has."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int = 10) -> None:
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, set]] = []  # of each window: its length, its items
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for item, raw in items:
            for window in windows(raw.translate(NORMAL).split(), width):
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                found = self.search.get(key, -1)
                if found < 0:
                    found = len(self.items)
                    self.items.append((len(key), set()))
                    self.search.add_word(key, found)
                if item is not None:
                    self.items[found][1].add(item)
        self.search.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words; the word ranges (start, end exclusive) of all occurrences, merged and in order; the items that occur."""
        total, found, items, scan, get = 0, [], set(), None, self.number.get
        for _, part in pieces(raw):
            numbers = tuple(map(get, part.split(), itertools.repeat(0)))
            if any(numbers) and self.items:
                if scan is None:
                    scan = self.search.iter(numbers)
                    shift = total
                else:
                    scan.set(numbers, False)
                for end, window in scan:
                    length, owners = self.items[window]
                    found.append((end + shift + 1 - length, end + shift + 1))
                    items |= owners
            elif scan is not None:
                scan.set(numbers, False)
                for _ in scan:
                    pass
            total += len(numbers)
        return total, merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def word_places(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The code points (start, end exclusive) of the original text that the word ranges cover."""
    starts, ends = [], []
    before = 0
    for _, part in pieces(raw):
        octets = np.frombuffer(part, np.uint8)
        inside = octets != 32
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        point = before + np.concatenate([[0], np.cumsum((octets & 0xC0) != 0x80)])
        starts.append(point[edge[::2]])
        ends.append(point[edge[1::2]])
        before = int(point[-1])
    starts, ends = np.concatenate(starts or [np.zeros(0, int)]), np.concatenate(ends or [np.zeros(0, int)])
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


#: The automaton that a worker used last, by the number of its broadcast.
_LAST: dict[str, Automaton] = {}


RANGES = "array<struct<start: long, end: long, first: long, last: long>>"


def _scanner(items: Broadcast, name: str, width: int, places: bool):
    span = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "end", "first", "last")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LAST:
            _LAST.clear()
            _LAST[name] = Automaton(items.value, width)
        automaton = _LAST[name]
        for batch in batches:
            n, hits, owners = [], [], []
            for text in batch.column(2):
                raw = text.as_buffer().to_pybytes()
                total, found, here = automaton.scan(raw)
                points = word_places(raw, found) if places and found else [(None, None)] * len(found)
                n.append(total), owners.append(sorted(here))
                hits.append([{"start": a, "end": b, "first": c, "last": d} for (a, b), (c, d) in zip(found, points, strict=True)])
            columns = [pa.array(n, pa.int64()), pa.array(hits, span), pa.array(owners, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "row", "n_words", "hits", "items"])

    return run


def _union(ranges: str) -> F.Column:
    """Ranges of several scans, merged and in order."""

    def add(out, r):
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"), last["first"].alias("first"), F.greatest(last["last"], r["last"]).alias("last"))
        return F.when((F.size(out) > 0) & (r["start"] <= last["end"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(F.array_sort(F.flatten(F.collect_list(ranges))), F.array().cast(RANGES), add)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, places: bool = True, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_words, hits, items (ids of the items of ``benchmark(item_id, text, ...)`` with an occurring window, ascending).

    Hits are the ranges of words inside an occurring window, merged: start and end (exclusive) count words, first and last
    (exclusive) are the code points of the original text, null without ``places``.

    A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. The benchmark
    is collected in blocks of at most ``most_windows`` words (so no more windows), each of which is one automaton, broadcast;
    usually one block has it all. With more, every block scans the texts and ranges meet by document.

    Null and empty texts have no words and no hits. Repeated documents each have their row; items that repeat an id count once; an
    item with a null id marks words but is in no list. Texts of any length pass in pieces; a run without a separator is
    one word. Items without words match nothing, and an empty benchmark nothing at all; no documents give no rows. Other columns are not read.
    An item of more than ``most_windows`` words is a block of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    words = F.octet_length("text") / 2 + 1  # no text has more words
    blocks = max(1, int(-(-(items.agg(F.sum(words)).first()[0] or 0) // most_windows)))
    row = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text"), 256) if blocks > 1 else F.lit(None).cast("string")
    slim = slim.select("doc_id", row.alias("row"), "text")
    schema = f"doc_id long, row string, n_words long, hits {RANGES}, items array<long>"
    scans = []
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r["item_id"], bytes(r["text"])) for r in mine.collect()])
        scans.append(slim.mapInArrow(_scanner(shared, uuid.uuid4().hex, width, places), schema))
    if blocks == 1:
        return scans[0].drop("row")
    every = [stage(s, "contamination") for s in scans]
    found = every[0].where("size(hits) > 0").withColumn("block", F.lit(0))
    for block, s in enumerate(every[1:], 1):
        found = found.unionByName(s.where("size(hits) > 0").withColumn("block", F.lit(block)))
    by = found.dropDuplicates(["row", "block"]).groupBy("row").agg(_union("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return every[0].select("doc_id", "row", "n_words").join(by, "row", "left").select("doc_id", "n_words", F.coalesce("hits", F.array().cast(RANGES)).alias("hits"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``contamination`` for all documents and items; odd rows as there."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), places=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(words[p : p + n - 1], ' ') AS win FROM (SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS p FROM b WHERE len(words) > 0)),
d AS (SELECT doc_id, n, p, array_to_string(words[p : p + n - 1], ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM w, (SELECT DISTINCT n FROM i) WHERE len(words) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, p, n FROM d JOIN i USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

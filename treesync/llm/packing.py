"""Packing by concatenate and cut.

Pass 1 tokenises every document once and writes its ids with their place inside the block (scan partition). Block
totals, one number per block, are summed into offsets. Pass 2 reads the ids, adds the offset and cuts at the multiples
of the window: documents that cross a boundary become several pieces. No token is shuffled.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import small_batches, stage, table

#: Most entries of a worker's cache of encoded chunks.
CACHE_ROWS = 400_000


class _Chunks(dict):
    """chunk -> ids of ' ' + chunk, as bytes of unsigned 16-bit numbers; emptied when full."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_ROWS:
            self.clear()
        out = array("H", self.encode(" " + chunk)).tobytes()
        if len(chunk) < 24:
            self[chunk] = out
        return out


def byte_bpe_encoder(tokenizer_json: str | None = None, rank_file: str | None = None) -> Callable[[str], bytes]:
    """text -> ids (unsigned 16-bit, native order) as the tokenizers library gives for the byte-level vocabulary.

    A space between two characters that aren't white space always begins a pre-token, so texts are cut there and the
    chunks encoded by themselves, through a bounded cache. Texts with other white space around spaces are encoded whole.
    The end-of-text token's string in a text is that token, as in the library.
    """
    import base64
    import json
    import re

    import public_tokenizers
    import tiktoken

    with open(tokenizer_json or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    chunks = _Chunks(encode)
    get = chunks.__getitem__
    odd = re.compile(r"\s[ ]|[ ]\s|[ ]$")
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def plain(text: str) -> bytes:
        if odd.search(text):
            return array("H", encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("H", encode(first)).tobytes() + b"".join(map(get, rest))

    def whole(text: str) -> bytes:
        if marks is None or not any(s in text for s in special):
            return plain(text)
        return b"".join(array("H", [special[x]]).tobytes() if x in special else plain(x) for x in marks.split(text) if x)

    return whole


_ENCODERS: dict[tuple, Callable[[str], bytes]] = {}


def encoder(*files: str | None) -> Callable[[str], bytes]:
    """One encoder per worker process."""
    if files not in _ENCODERS:
        _ENCODERS[files] = byte_bpe_encoder(*files)
    return _ENCODERS[files]


def _tokenise(end_id: int, files: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, block, end = encoder(*files), 0, TaskContext.get().partitionId(), array("H", [end_id]).tobytes()
        for batch in batches:
            ids = [encode(x or "") + end for x in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), block, np.int32)), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(ids, pa.binary())],
                ["doc_id", "block", "start", "doc_tokens", "ids"],
            )
            start += int(sizes.sum())

    return run


def _cut(window: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, length, crc, total, seq, off, kept = [], [], [], [], [], [], [], []
            for doc_id, at, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, np.uint16).astype("<u4")
                done = 0
                while done < n:
                    place = at + done
                    size = min(n - done, window - place % window)
                    piece = ids[done : done + size].tobytes()
                    doc.append(doc_id), start.append(done), length.append(size), crc.append(zlib.crc32(piece)), total.append(n)
                    seq.append(place // window), off.append(place % window)
                    if with_ids:
                        kept.append(piece)
                    done += size
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, seq, off)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    return run


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, with_ids: bool = False, tokenizer_json: str | None = None, rank_file: str | None = None) -> DataFrame:
    """Sequences of ``window`` tokens (the last one may be shorter) from ``docs(doc_id, text, ...)``; one row per piece.

    Columns: doc_id, start (its document's ids before the piece), length, ids_crc32 (of little-endian unsigned 32-bit
    ids), doc_tokens, sequence_id, offset, and ``ids`` (those bytes) if asked for. Every document ends with ``end_id``. Null
    text counts as empty: one piece with that id. Repeated rows are packed each by itself, null ids stay null, other
    columns are not read, and an empty table gives no pieces. Which document precedes which follows the scan.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _tokenise(end_id, (tokenizer_json, rank_file)), "doc_id long, block int, start long, doc_tokens long, ids binary"
        ),
        "tokens",
        "zstd",
    )
    base, offsets = 0, {"block": [], "base": []}
    for r in sorted(tokens.groupBy("block").agg(F.sum("doc_tokens").alias("n")).collect()):  # one number per block
        offsets["block"].append(r["block"])
        offsets["base"].append(base)
        base += r["n"]
    # an Arrow table: a list of rows would be an RDD of Python objects, for which every executor starts a second pool of workers
    offsets = spark.createDataFrame(pa.table(offsets, pa.schema([("block", pa.int32()), ("base", pa.int64())])))
    placed = tokens.join(F.broadcast(offsets), "block").select("doc_id", (F.col("base") + F.col("start")).alias("at"), "doc_tokens", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_cut(window, with_ids), schema + ", ids binary" * with_ids)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens; odd rows as in ``pack``."""
    return pack(table(spark, sf_dir, "documents"))

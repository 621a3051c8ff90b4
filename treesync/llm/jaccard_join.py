"""Similarity join on word shingles by a grouped prefix join.

Exactly, for a threshold of 75 in 100: two sets that link share a token among the first n - ceil(3n/4) + 1 of each, in any
order that is the same for all documents. The order here is rare first, by a counting sketch over all documents.

1. Documents with equal sets are one class; classes of equal prefix and size are one group.
2. Group prefixes are dealt out by ranges of (token, a hash of the group, group), so that a token of very many groups is
   spread over tasks.
3. Pairs are looked at if they share a prefix token that may be their first (sizes and positions), and enough prefix
   tokens. Round one verifies, in each list, a group with the one that follows in the order of the hash, and with the one
   that has the token first, which is nearest to what the list has in common. Both are mostly the same in all lists of
   a near copy: a few pairs a document, however many copies. Members of a group are compared with its first one.
4. Then components are known. Round two takes the lists with more than one component; entries outside the list's largest
   one look for all partners of other components, by bands of size and in blocks, so that no token is a hot key. Every pair
   of groups (expanded to their members) that passes the filters and is not connected yet is verified. No such pair is
   left out, so components are those of the complete join, while large groups of near copies cost no square of pairs.

Sets are verified on hashes that are computed once for each candidate document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.llm.common import bounded, components, join_classes, small_batches, stage, sum_vectors, table

#: Counters of the sketch that orders shingles (its sums are broadcast: 4 MB), and of one message.
BUCKETS, CHUNK = 1 << 20, 1 << 12
#: Most entries of a worker's cache of word hashes.
CACHE_ROWS = 100_000
#: Entries of a block of those that look for partners, and of a block of possible partners, under one token and band of sizes.
SEEKERS, PARTNERS = 1_000, 4_000
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ROWS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z in lower case, words between blanks; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    width, rows = min(size, n), max(1, n - size + 1)
    s = np.full(rows, size - width, np.uint64)
    for i in range(width):
        s = s * K1 + h[i : i + rows]
    s = (s ^ (s >> np.uint64(29))) * K2
    return np.unique(s ^ (s >> np.uint64(32)))


def similar(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sets = [shingle_set(x, size) for x in batch.column(1).to_pylist()]
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        parts = counts.reshape(-1, CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        _WORDS.clear()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["key", "vec"])

    return run


def _prefixes(size: int, percent: int, order):
    names = ["doc_id", "n", "d1", "d2", "g1", "g2", "prefix"]

    def two(x: np.ndarray) -> tuple[int, int]:
        d = xxhash.xxh3_128_digest(x.tobytes())
        return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                n = len(s)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                often = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                prefix = s[np.argsort(often, kind="stable")[:keep]].view(np.int64)
                rows.append((n, *two(s), *two(prefix), prefix))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int64()))], names
            )
        _WORDS.clear()

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token: those whose token another row has, or may have in the next task.

    With each comes the row that follows in its list (n2, doc2, pos2) and one of least position (n3, doc3, pos3), of those
    of its batch and of what came before: few rare shingles stand before the token there, so it is near what the list has in common.
    """
    names = [f"{c}{i}" for i in ("", "2", "3") for c in ("n", "doc", "pos")]
    held = best = None
    first, previous_same = True, False

    def out(rows: list[np.ndarray], following: np.ndarray, top: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
        after = [np.where(following, np.append(c[1:], 0), 0)[keep] for c in rows[1:]]
        mask = ~following[keep]
        columns = [pa.array(c[keep], pa.int64()) for c in rows] + [pa.array(c, pa.int64(), mask=mask) for c in after] + [pa.array(c[keep], pa.int64()) for c in top]
        return pa.RecordBatch.from_arrays(columns, ["token", *names])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            rows = [np.append(h, r) for h, r in zip(held, rows, strict=True)]
        m, token = len(rows[0]), rows[0]
        if not m:
            continue
        following = np.append(token[1:] == token[:-1], False)
        before = np.append(previous_same, following[:-1])
        run = np.cumsum(~before) - (not before[0])
        order = np.lexsort((rows[2], rows[3], run))
        least = order[np.searchsorted(run[order], np.arange(run[-1] + 1))]  # by run
        tops = [c[least] for c in rows[1:]]
        if before[0] and best is not None and (best[2], best[1]) <= (tops[2][0], tops[1][0]):
            for c, x in zip(tops, best, strict=True):
                c[0] = x
        keep = following | before
        keep[0] |= first
        keep[-1] = False  # the last row waits for the next batch
        yield out(rows, following, [c[run] for c in tops], keep)
        first = first and m == 1
        previous_same = bool(before[-1])
        best = [c[-1] for c in tops]
        held = [r[-1:] for r in rows]
    if held is not None:
        yield out(held, np.array([False]), [np.array([x]) for x in best], np.array([True]))


def _may_be_first(percent: int):
    """Filters on a shared token as the first that two sets share: sizes, and what can match from its positions on. Sets that link pass at their first."""
    low, high = F.least("n", "n2"), F.greatest("n", "n2")
    rest = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    return (100 * low >= percent * high) & (rest * (100 + percent) >= percent * (F.col("n") + F.col("n2")))


def _least_shared(percent: int):
    """Prefix tokens that two sets of n and n2 must share to link.

    In the common order, tokens up to the end of the prefix that ends first are in both prefixes or not shared at all, so
    the intersection is at most the shared prefix tokens plus what follows that prefix in its set.
    """
    behind = F.greatest(*(F.ceil(percent * F.col(c) / 100) - 1 for c in ("n", "n2")))
    return F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent)) - behind


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, size).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "hashes"])
        _WORDS.clear()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(i)] for i in (2, 3)]
            good = np.array([similar(x, y, percent) for x, y in zip(*sides, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["a", "b"])

    return run


class _Join:
    """The staged tables of one join: classes of equal sets, their groups, and the lists of groups by prefix token."""

    def __init__(self, docs: DataFrame, percent: int, size: int) -> None:
        spark = docs.sparkSession
        small_batches(spark)
        self.percent, self.size = percent, size
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

        # The order: how many documents have a shingle of the same bucket.
        counts = np.zeros(BUCKETS, np.int32)
        for r in sum_vectors(self.docs.mapInArrow(_sketch(size), "key int, vec binary")).toLocalIterator():  # BUCKETS numbers in all
            counts[r["key"] * CHUNK : (r["key"] + 1) * CHUNK] = np.minimum(np.frombuffer(r["vec"], np.int64), np.iinfo(np.int32).max)
        order = spark.sparkContext.broadcast(counts)
        schema = "doc_id long, n long, d1 long, d2 long, g1 long, g2 long, prefix array<long>"
        self.rows = stage(self.docs.mapInArrow(_prefixes(size, percent, order), schema), "prefixes")

        # Classes of equal sets; groups of equal prefix and size.
        classes = self.rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc"), F.min("g1").alias("g1"), F.min("g2").alias("g2"), F.count("*").alias("weight"))
        self.classes = stage(classes.where("doc is not null"), "classes")
        groups = self.classes.groupBy("n", "g1", "g2").agg(F.min("doc").alias("grp"), F.count("*").alias("weight"))
        self.members = stage(join_classes(self.classes.select("doc", "n", "g1", "g2"), groups, ["n", "g1", "g2"], "inner").select("doc", "grp"), "members")
        heads = stage(self.members.where("doc = grp").select("doc"), "heads")
        self.heads = self.rows.where("n > 0").select(F.col("doc_id").alias("doc"), "n", "prefix").join(bounded(heads), "doc", "left_semi")

        by_chance = (F.col("token"), F.xxhash64("doc"), F.col("doc"))
        entries = self.heads.select("doc", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "doc", F.col("pos").cast("long").alias("pos"))
        dealt = entries.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by_chance).sortWithinPartitions(*by_chance)
        columns = ", ".join(f"{c} long" for c in ("token", "n", "doc", "pos", "n2", "doc2", "pos2", "n3", "doc3", "pos3"))
        self.lists = stage(dealt.mapInArrow(_neighbours, columns), "lists", batch_rows=50_000)
        self.sets: DataFrame | None = None
        self.have: DataFrame | None = None

    def may_link(self, met: DataFrame) -> DataFrame:
        """Those of ``met(ga, gb, n, n2)`` that share enough prefix tokens to link."""
        met = stage(met, "met")
        wanted = stage(met.select(F.col("ga").alias("doc")).union(met.select("gb")).distinct(), "met-groups")
        prefixes = self.rows.where("n > 0").select(F.col("doc_id").alias("doc"), "d1", "d2", "prefix").join(bounded(wanted), "doc", "left_semi")
        prefixes = stage(prefixes.dropDuplicates(["doc", "d1", "d2"]).select("doc", "prefix"), "met-prefixes")
        a, b = (prefixes.select(F.col("doc").alias(f"g{s}"), F.col("prefix").alias(f"p{s}")) for s in "ab")
        met = met.join(a, "ga").join(b, "gb").withColumn("shared", F.size(F.array_intersect("pa", "pb")).cast("long"))
        return met.where(F.col("shared") >= _least_shared(self.percent)).select("ga", "gb").distinct()

    def verified(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``pairs(a, b)``, staged, and those of them that link. Sets are computed for documents that no earlier call had."""
        pairs = stage(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        wanted = stage(wanted if self.have is None else wanted.join(self.have, "doc", "left_anti"), "wanted")
        texts = self.docs.select(F.col("doc_id").alias("doc"), "text").join(bounded(wanted), "doc", "left_semi")
        new = stage(texts.mapInArrow(_sets(self.size), "doc long, hashes binary").dropDuplicates(), "sets")
        self.sets, self.have = (new, wanted) if self.sets is None else (self.sets.unionByName(new), self.have.unionByName(wanted))
        left, right = (self.sets.select(F.col("doc").alias(s), F.col("hashes").alias(f"h{s}")) for s in "ab")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "hb")
        return pairs, stage(both.mapInArrow(_verify(self.percent), "a long, b long").distinct(), "links")

    def first(self) -> tuple[DataFrame, DataFrame]:
        """Round one: each group with its neighbour and the first one of its lists, and the members of groups with their first."""
        met = [
            self.lists.where(f"doc{i} is not null and doc <> doc{i}").select("n", "doc", "pos", *(F.col(f"{c}{i}").alias(f"{c}2") for c in ("n", "doc", "pos")))
            for i in (2, 3)
        ]
        near = met[0].unionByName(met[1]).where(_may_be_first(self.percent)).select(*_in_order("doc", "doc2")).distinct()
        inside = self.members.where("doc <> grp").select(F.col("grp").alias("a"), F.col("doc").alias("b"))
        return self.verified(self.may_link(near).select(F.col("ga").alias("a"), F.col("gb").alias("b")).unionByName(inside))

    def apart(self, linked: DataFrame, tried: DataFrame | None) -> DataFrame:
        """All pairs (a, b) of classes that may link, share a token or group, and are neither connected by ``linked(id, component_id)`` nor tried."""
        root = self.members.join(linked.withColumnRenamed("id", "doc"), "doc", "left").withColumn("root", F.coalesce("component_id", "doc")).drop("component_id")
        root = stage(root, "roots")
        by_group = root.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        of = stage(self.lists.select("token", "n", "doc", "pos").join(by_group.withColumnRenamed("grp", "doc"), "doc"), "listed")
        mixed = of.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
        of = stage(of.join(bounded(stage(mixed, "mixed")), "token", "left_semi"), "in-mixed")
        # Most entries of a token are of one component as a rule; pairs within it need no look, so only the others seek partners.
        sums = of.where("low = high").groupBy("token", F.col("low").alias("most")).agg(F.count("*").alias("c"))
        most = sums.groupBy("token").agg(F.max_by("most", F.struct("c", "most")).alias("most"))
        of = of.join(most, "token", "left").withColumn("minor", ~F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == F.col("most")), F.lit(False))).drop("most")
        # Sets that link are of the same band of sizes or of neighbouring ones.
        of = stage(of.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.1 / self.percent))).cast("int")), "banded")
        right = of.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *(F.col(c).alias(f"{c}2") for c in ("n", "doc", "pos", "low", "high", "minor")))
        seekers = of.where("minor").groupBy("token", "band").agg(F.ceil(F.count("*") / SEEKERS).alias("rows"))
        blocks = right.groupBy("token", "band").agg(F.ceil(F.count("*") / PARTNERS).alias("columns")).join(seekers, ["token", "band"]).where("rows > 1 or columns > 1")
        blocks = bounded(stage(blocks, "blocks"))
        one = lambda c: F.coalesce(c, F.lit(1))
        left = of.where("minor").drop("minor").join(blocks, ["token", "band"], "left").withColumn("i", F.pmod(F.xxhash64("doc"), one("rows")))
        left = left.withColumn("j", F.explode(F.sequence(F.lit(0), (one("columns") - 1).cast("int")))).drop("rows", "columns")
        right = right.join(blocks, ["token", "band"], "left").withColumn("j", F.pmod(F.xxhash64("doc2"), one("columns")))
        right = right.withColumn("i", F.explode(F.sequence(F.lit(0), (one("rows") - 1).cast("int")))).drop("rows", "columns")
        key = ["token", "band", "i", "j"]
        right = right.select(*(F.col(c).alias(f"{c}_") for c in key), "n2", "doc2", "pos2", "low2", "high2", "minor2")
        meet = F.expr("doc <> doc2 and (doc < doc2 or not minor2) and not (low = high and low2 = high2 and low = low2)") & _may_be_first(self.percent)
        for c in key:
            meet = (F.col(c) == F.col(f"{c}_")) & meet
        met = self.may_link(left.join(right, meet).select(*_in_order("doc", "doc2")).distinct())
        same = by_group.where("low <> high").select(F.col("grp").alias("ga"), F.col("grp").alias("gb"))
        ma, mb = (root.select(F.col("grp").alias(f"g{s}"), F.col("doc").alias(s), F.col("root").alias(f"r{s}")) for s in "ab")
        full = met.unionByName(same).join(ma, "ga").join(mb, "gb").where("ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return stage(full if tried is None else full.join(tried, ["a", "b"], "left_anti"), "apart")


def _in_order(x: str, y: str) -> tuple:
    mine = F.col(x) < F.col(y)
    return F.least(x, y).alias("ga"), F.greatest(x, y).alias("gb"), F.when(mine, F.col("n")).otherwise(F.col("n2")).alias("n"), F.when(mine, F.col("n2")).otherwise(F.col("n")).alias("n2")


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id (the smallest doc_id reachable over links).

    Documents link when 100 * intersection >= percent * union of their sets of ``size``-word shingles. Null text counts as
    empty; without words the set is empty and the document links with nothing. Rows with a null doc_id link with nothing
    of their own (component_id null). doc_id should name one text; where it names several, a link of one of them counts for it. Very
    long texts are one set in a worker's memory, 8 bytes a shingle. An empty table gives no rows; other columns are not read.
    """
    join = _Join(docs, percent, size)
    tried, links = join.first()
    linked = components(links)
    rest = join.apart(linked, tried)
    if not rest.isEmpty():
        _, new = join.verified(rest)
        if not new.isEmpty():
            linked = components(links.unionByName(new))
    found = join.classes.join(linked.withColumnRenamed("id", "doc"), "doc", "left").select("n", "d1", "d2", F.coalesce("component_id", "doc").alias("component_id"), "weight")
    narrow = join.rows.select("doc_id", "n", "d1", "d2")
    out = join_classes(narrow.where("n > 0"), stage(found, "found"), ["n", "d1", "d2"]).select("doc_id", "n", "component_id")
    out = out.unionByName(narrow.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def similar_pairs(docs: DataFrame, percent: int = 75, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """The complete join: all links (a, b), a < b, between classes of equal sets, and the classes (doc_id, class_id).

    A class is named by its smallest doc_id. Nothing is skipped because it is connected already, so the work grows with
    the links; ``near_duplicates`` needs no more than the components. Documents without words are in no class. Odd rows as there.
    """
    join = _Join(docs, percent, size)
    rest = join.apart(join.docs.sparkSession.createDataFrame([], "id long, component_id long"), None)
    _, links = join.verified(rest)
    classes = stage(join.classes.select("n", "d1", "d2", F.col("doc").alias("class_id"), "weight"), "class-ids")
    named = join_classes(join.rows.where("n > 0").select("doc_id", "n", "d1", "d2"), classes, ["n", "d1", "d2"], "inner")
    return links, named.select("doc_id", "class_id")


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with the document of smallest id of each component; columns kept, whatever their names. Rows with a null id stay."""
    gone = stage(near_duplicates(docs, percent).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(bounded(gone), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of all documents; odd rows as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))

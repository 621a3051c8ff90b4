"""Running sums, positions and greedy batches over sorted rows, in parallel whatever the size of a group.

Rows are range-partitioned and sorted once. A first pass over the partitions says what each does to a value that enters it,
one row per partition and group at its edges; those are chained; a second pass starts each partition from the value that
enters it. Rows stream by in Arrow batches and aren't shuffled again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesync.functions.shared import shared_folder

#: Names of the columns that are added while rows are sorted.
PART, TIE = "__part", "__tie"


def ranged(rows: DataFrame, by: list[str], order: list[Column | str], partitions: int | None = None) -> DataFrame:
    """``rows`` sorted by the group columns and the order, spread evenly over range partitions whose number is in the column ``__part``.

    Checkpointed: a partition is one file of the shared folder, which keeps its rows in order. Ties are broken by an
    arbitrary number, so no number of equal keys lands in one partition.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.asc_nulls_first(c) for c in by), *((F.asc_nulls_first(c) if isinstance(c, str) else c.asc_nulls_first()) for c in order), F.asc(TIE)]
    out = rows.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return out.drop(TIE).withColumn(PART, F.spark_partition_id()).checkpoint()


def starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Where a new group begins in a batch of sorted rows; ``before`` is the group of the row before the batch. Nulls are one group."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, bool)
    for c in columns:
        if n > 1:
            a, b = c.slice(0, n - 1), c.slice(1)
            same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
    if n:
        out[0] = before is None or before != tuple(c[0].as_py() for c in columns)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + more


def _running(names: list[str], by: list[str], values: list[str], outs: list[str]):
    """Per batch, inclusive running sums of ``values`` within the groups; the first group of a partition starts from the columns ``__in_*``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carry = None, None
        for batch in batches:
            col = lambda name: batch.column(names.index(name))  # noqa: E731, B023
            n = batch.num_rows
            if not n:
                continue
            groups = [col(c) for c in by]
            new = starts(groups, before) if by else np.array([before is None] + [False] * (n - 1))
            if before is None:  # what enters is for the first group alone
                carry, new[0] = [_numbers(col(f"__in_{i}").slice(0, 1))[0] for i in range(len(values))], False
            at = np.flatnonzero(new)
            sums = []
            for i, v in enumerate(values):
                total = np.cumsum(_numbers(col(v)))
                base = np.full(n, -carry[i], np.int64)
                for k, start in enumerate(at.tolist()):
                    base[start : at[k + 1] if k + 1 < len(at) else n] = total[start - 1] if start else 0
                sums.append(total - base)
            before, carry = tuple(g[n - 1].as_py() for g in groups), [s[-1] for s in sums]
            kept = [(batch.column(i), c) for i, c in enumerate(names) if not c.startswith("__in_")]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), *map(pa.array, sums)], [*(c for _, c in kept), *outs])

    return run


def _scan(rows: DataFrame, by: list[str], values: list[str], outs: list[str], down: list[Column] | None = None) -> DataFrame:
    """Add the running sums ``outs`` of ``values`` to sorted ``rows``; with ``down``, a descending order that partitions are to be sorted by, from the last row of a group to its first."""
    edge = rows.groupBy(PART, *by).agg(*(F.sum(v).alias(f"__sum_{i}") for i, v in enumerate(values)))
    w = Window.partitionBy(*by).orderBy(F.desc(PART) if down else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    entering = edge.select(F.col(PART).alias("__p"), *(F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)), *(F.sum(f"__sum_{i}").over(w).alias(f"__in_{i}") for i in range(len(values))), F.count("*").over(w).alias("__before"))
    entering = entering.where("__before > 0").drop("__before")  # groups that began in another partition: one a partition at most
    on = F.col(PART) == F.col("__p")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    joined = rows.join(F.broadcast(entering), on, "left").drop("__p", *(f"__by_{i}" for i in range(len(by))))
    joined = joined.sortWithinPartitions(*down) if down else joined  # after the join: below one, Spark drops a sort
    schema = _schema(rows, "".join(f", `{o}` long" for o in outs))
    return joined.mapInArrow(_running(joined.columns, by, values, outs), schema)


def running_sums(rows: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str], totals: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """``rows`` with the columns ``sums`` (name: column of whole numbers, null counting as 0), running sums within each group ``by`` in the given order, the row itself included; ``totals`` (name: name of a sum) adds the group's whole sums.

    One range exchange, whatever the size of a group: what enters a partition is a row a partition. Totals take a second pass,
    from the end: a sum up to a row and the one down from it have the row in common. Null groups are a group; ties are in any order.
    """
    names, values = list(sums), list(sums.values())
    out = _scan(ranged(rows, by, order, partitions), by, values, names)
    if totals:
        upward = [F.desc("__at")]
        numbered = out.withColumn("__at", F.monotonically_increasing_id())
        down = _scan(numbered, by, [sums[s] for s in totals.values()], [f"__down_{t}" for t in totals], upward)
        out = down.withColumns({t: F.col(s) + F.col(f"__down_{t}") - F.coalesce(F.col(sums[s]), F.lit(0)) for t, s in totals.items()}).drop("__at", *(f"__down_{t}" for t in totals))
    return out.drop(PART)


def position(rows: DataFrame, by: list[str], order: list[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """``rows`` with their 0-based position in their group."""
    out = running_sums(rows.withColumn("__one", F.lit(1).cast("long")), by, order, {name: "__one"}, partitions=partitions)
    return out.drop("__one").withColumn(name, F.col(name) - 1)


# Greedy batches: a batch closes once its bytes reach the limit, so what a partition does depends on the bytes that enter it


def greedy_run(sizes: np.ndarray, limit: int, run: int = 0, batch: int = 0) -> tuple[np.ndarray, int, int]:
    """Batch number of each size, and the running size and batch after them; a batch closes once its running size reaches ``limit``, and the file that crosses stays in."""
    ends, out, start = np.cumsum(sizes), np.empty(len(sizes), np.int64), 0
    while start < len(sizes):
        base = (ends[start - 1] if start else 0) - run
        stop = int(np.searchsorted(ends, base + limit, "left")) + 1
        out[start : min(stop, len(sizes))] = batch
        if stop > len(sizes):
            return out, int(ends[-1] - base), batch
        start, run, batch = stop, 0, batch + 1
    return out, run, batch


def passage(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a run of sizes does to any running size r that enters it: (ends, closed, left).

    The first batch closes at the first i with ends[i] >= limit - r; if none does, r + ends[-1] leaves. From there on r doesn't matter: closed[i]
    batches have been closed by the end, and left[i] bytes are in the open one. Each i points to the next boundary after it, so one
    pass from the end gives all. Neighbours that lead to the same are kept once.
    """
    ends = np.cumsum(sizes)
    n = len(ends)
    following = np.searchsorted(ends, ends + limit, "left")
    closed, left = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = following[i]
        closed[i], left[i] = (1 + closed[j], left[j]) if j < n else (1, ends[-1] - ends[i])
    ends, closed, left = ends, closed[:n], left[:n]
    keep = np.r_[(closed[1:] != closed[:-1]) | (left[1:] != left[:-1]), [True]] if n else np.zeros(0, bool)  # the last of equal neighbours
    return ends[keep], closed[keep], left[keep]


def passed(run: int, total: int, limit: int, ends: np.ndarray, closed: np.ndarray, left: np.ndarray) -> tuple[int, int]:
    """(batches closed, running size) after a run of sizes that ``run`` entered; ``total`` is their sum."""
    if run + total < limit:
        return 0, run + total
    i = int(np.searchsorted(ends, limit - run, "left"))
    return int(closed[i]), int(left[i])


def _packed(*arrays: np.ndarray) -> bytes:
    """Numbers that mostly grow evenly, so their differences compress."""
    return zlib.compress(b"".join(np.diff(a, prepend=0).astype(np.int64).tobytes() for a in arrays), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    return list(np.cumsum(np.frombuffer(zlib.decompress(data), np.int64).reshape(3, -1), axis=1))


def _passages(limit: int, kinds: list[pa.DataType]):
    """From sorted (__part, by..., size): the passage of the first and the last group of the partition; a group between begins and ends here."""
    names = ["part", *(f"by{i}" for i in range(len(kinds))), "total", "table"]

    def row(part: int, group: tuple, sizes: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.concatenate(sizes)
        columns = [pa.array([part], pa.int32()), *(pa.array([g], k) for g, k in zip(group, kinds, strict=True))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([int(whole.sum())]), pa.array([_packed(*passage(whole, limit))], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, first, part = None, [], True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, groups, sizes = batch.column(0)[0].as_py(), batch.columns[1:-1], _numbers(batch.column(batch.num_columns - 1))
            cuts = np.flatnonzero(starts(groups, group) if groups else np.array([group is None] + [False] * (batch.num_rows - 1))).tolist()
            for k, start in enumerate([0, *cuts] if not cuts or cuts[0] else cuts):
                if start in cuts:
                    if held and first:
                        yield row(part, group, held)
                        first = False
                    group, held = tuple(g[start].as_py() for g in groups), []
                ends = [c for c in cuts if c > start]
                held.append(sizes[start : ends[0] if ends else len(sizes)])
        if held:
            yield row(part, group, held)

    return run


def _chain(limit: int, width: int):
    """From the passages of a group in order of partitions: what enters each partition."""
    names = ["part", *(f"by{i}" for i in range(width)), "run", "batch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, number = None, 0, 0
        for batch in batches:
            runs, numbers = [], []
            for i in range(batch.num_rows):
                here = tuple(batch.column(1 + k)[i].as_py() for k in range(width))
                if group is None or here != group:
                    group, size, number = here, 0, 0
                runs.append(size), numbers.append(number)
                more, size = passed(size, batch.column(1 + width)[i].as_py(), limit, *_unpacked(batch.column(2 + width)[i].as_py()))
                number += more
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + width], pa.array(runs, pa.int64()), pa.array(numbers, pa.int64())], names)

    return run


def _number(names: list[str], by: list[str], size: str, limit: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, running, number = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda name: batch.column(names.index(name))  # noqa: E731, B023
            groups, sizes, found = [col(c) for c in by], _numbers(col(size)), np.empty(n, np.int64)
            new = starts(groups, before) if by else np.array([before is None] + [False] * (n - 1))
            if before is None:
                running, number, new[0] = int(_numbers(col("__run").slice(0, 1))[0]), int(_numbers(col("__batch").slice(0, 1))[0]), False
            cuts = [0, *np.flatnonzero(new).tolist(), n]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if new[start]:
                    running, number = 0, 0
                if end > start:
                    found[start:end], running, number = greedy_run(sizes[start:end], limit, running, number)
            before = tuple(g[n - 1].as_py() for g in groups)
            kept = [(batch.column(i), c) for i, c in enumerate(names) if c not in ("__run", "__batch")]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(found)], [*(c for _, c in kept), out])

    return run


def greedy_batches(rows: DataFrame, by: list[str], order: list[Column | str], limit: int, size: str = "size", name: str = "batch", partitions: int | None = None) -> DataFrame:
    """``rows`` with the number of their greedy batch within each group: rows are taken in order, and a batch closes once its sizes reach ``limit``.

    Equal to folding the rows one by one, but a group of any size is spread over range partitions: each says, for every
    running size that may enter it, how many batches it closes and what it leaves open. Only that, in compressed form, is
    chained, a row a partition. A task holds the sizes of its own partition, eight bytes a row. Unknown sizes count as 0.
    """
    if limit < 1:
        raise ValueError("a batch needs a limit of 1 or more")
    sorted_rows = ranged(rows, by, order, partitions)
    slim = sorted_rows.select(PART, *by, F.col(size).cast("long").alias("__size"))
    kinds = [f.dataType for f in sorted_rows.select(*by).schema.fields] if by else []
    from pyspark.sql.pandas.types import to_arrow_type

    fields = "".join(f", by{i} {k.simpleString()}" for i, k in enumerate(kinds))
    tables = slim.mapInArrow(_passages(limit, [to_arrow_type(k) for k in kinds]), f"part int{fields}, total long, table binary")
    groups = [f"by{i}" for i in range(len(kinds))]
    gathered = (tables.repartition(*groups) if groups else tables.repartition(1)).sortWithinPartitions(*groups, "part")
    entering = gathered.mapInArrow(_chain(limit, len(kinds)), f"part int{fields}, run long, batch long").where("run > 0 or batch > 0")
    entering = entering.select(F.col("part").alias("__p"), *(F.col(g).alias(f"__{g}") for g in groups), F.col("run").alias("__run"), F.col("batch").alias("__batch"))
    on = F.col(PART) == F.col("__p")
    for c, g in zip(by, groups, strict=True):
        on &= F.col(c).eqNullSafe(F.col(f"__{g}"))
    joined = sorted_rows.join(F.broadcast(entering), on, "left").drop("__p", *(f"__{g}" for g in groups))
    return joined.mapInArrow(_number(joined.columns, by, size, limit, name), _schema(sorted_rows, f", `{name}` long")).drop(PART)

"""Joins of rows with their classes (a size, a content, a reference) where a class may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class with more than one in so many rows is heavy; so there are at most so many heavy classes.
SHARES = 10_000
#: A class of no more rows than this is never heavy.
LIGHT = 1000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], weight: str = "weight", shares: int = SHARES, light: int = LIGHT) -> DataFrame:
    """``rows`` left-joined with ``classes(*keys, weight, ...)``, where weight is the number of rows of a class; weight is dropped.

    Heavy classes, a bounded number whatever the input, are broadcast, so their rows stay where they are; the rest is
    shuffled by the keys. ``rows`` are read twice and ``classes`` three times: stage them. Null keys have no class.
    """
    total = classes.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) > max(light, total // shares)
    few = classes.where(heavy).drop(weight)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(classes.where(~heavy).drop(weight), keys, "left")
    return rows.join(F.broadcast(few), keys).unionByName(rest)

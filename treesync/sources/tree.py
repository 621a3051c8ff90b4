"""Directory trees as a Spark data source, in batch and as a stream: ``spark.read.format("tree").option("path", root).load()``.

Register it once in a session with ``register(spark)``. Roots lie on file systems that all executors mount.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, Filter, InputPartition, Not, StringStartsWith

from treesync.functions.globs import compile_glob
from treesync.functions.shared import mounted
from treesync.sources.scan import _entry

SCHEMA = "path string, size long, permissions int, modified_epoch long, error string"
#: A file counts as arrived this long after its last change of content or name, so that none is missed that appears meanwhile.
SETTLED_NS = 100_000_000


@dataclass
class Rules:
    """What is looked at below a root, and where it isn't worth looking."""

    root: str
    excludes: str = ""
    follow: bool = True
    within: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)

    def enters(self, path: str, is_dir: bool) -> bool:
        """Whether a path can have rows: neither it nor its name is excluded, and no pushed filter speaks against it."""
        rel = path[len(self.root.rstrip("/")) + 1 :]
        if self.excludes and (re.match(self.excludes, rel) or re.match(self.excludes, os.path.basename(path))):
            return False
        below = path + "/"
        if any(path.startswith(p) or (is_dir and below.startswith(p)) for p in self.without):
            return False
        return all(path.startswith(p) or (is_dir and (p.startswith(below) or below.startswith(p))) for p in self.within)


@dataclass
class Directories(InputPartition):
    """Directories of one task: with ``deep``, all below them too; ``since`` and ``until`` bound the times of change, if set."""

    paths: list[str]
    deep: bool
    since: int | None = None
    until: int | None = None


def entries(directory: str, rules: Rules) -> Iterator[tuple]:
    """Rows (path, kind, size, permissions, modified_epoch, error) of a directory; one error row if it can't be listed."""
    try:
        with os.scandir(directory) as found:
            for e in found:
                row = _entry(e, rules.follow)
                if row and rules.enters(row[0], row[1] == "dir"):
                    yield row
    except OSError as e:
        yield directory, "error", None, None, None, str(e)


def split(rules: Rules, tasks: int, since: int | None = None, until: int | None = None) -> list[Directories]:
    """The tree as tasks: levels are listed from the top until there are ``tasks`` directories to go on from; those are walked whole by their tasks, the ones above listed again."""
    if not os.path.isdir(rules.root):
        raise FileNotFoundError(f"no directory: {rules.root}")
    above, frontier = [], [rules.root]
    while frontier and len(above) + len(frontier) < tasks:
        above += frontier
        frontier = [row[0] for d in frontier for row in entries(d, rules) if row[1] == "dir"]
    groups = [frontier[i::tasks] for i in range(min(tasks, len(frontier)))]
    return [Directories(g, True, since, until) for g in groups] + [Directories(above[i::tasks], False, since, until) for i in range(min(tasks, len(above)))]


def rows_of(part: Directories, rules: Rules) -> Iterator[tuple]:
    """FILES rows and errors of a task, one directory at a time."""
    todo = list(part.paths)
    while todo:
        for path, kind, size, mode, modified, error in entries(todo.pop(), rules):
            if kind == "dir":
                if part.deep:
                    todo.append(path)
                continue
            if part.until is not None:
                if error:
                    continue
                try:
                    changed = os.stat(path, follow_symlinks=rules.follow).st_ctime_ns
                except OSError:
                    continue  # gone again
                if not part.since < changed <= part.until:
                    continue
            yield path, size, mode, modified, error


class TreeReader(DataSourceReader):
    def __init__(self, rules: Rules, tasks: int) -> None:
        self.rules, self.tasks = rules, tasks

    def pushFilters(self, filters: list[Filter]):
        """Prefixes of the path prune the walk; all filters are given back, for Spark to apply to the rows."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.rules.within.append(f.value)
            if isinstance(f, Not) and isinstance(f.child, StringStartsWith) and f.child.attribute == ("path",):
                self.rules.without.append(f.child.value)
            yield f

    def partitions(self):
        return split(self.rules, self.tasks)

    def read(self, partition):
        return rows_of(partition, self.rules)


class TreeStream(DataSourceStreamReader):
    """Files that appeared or changed since the last batch, by their time of change (of content or name)."""

    def __init__(self, rules: Rules, tasks: int) -> None:
        self.rules, self.tasks = rules, tasks

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - SETTLED_NS}

    def partitions(self, start: dict, end: dict):
        return split(self.rules, self.tasks, start["until"], end["until"])

    def read(self, partition):
        return rows_of(partition, self.rules)


class TreeSource(DataSource):
    """Options: path; excludes, a JSON list of glob patterns; follow (true); tasks (32)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def _rules(self) -> tuple[Rules, int]:
        patterns = json.loads(self.options.get("excludes", "[]"))
        whole = "(?s)(?:" + "|".join(map(compile_glob, patterns)) + r")\Z" if patterns else ""
        follow = self.options.get("follow", "true").lower() == "true"
        return Rules(mounted(self.options["path"]).rstrip("/") or "/", whole, follow), int(self.options.get("tasks", "32"))

    def reader(self, schema) -> TreeReader:
        return TreeReader(*self._rules())

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(*self._rules())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)

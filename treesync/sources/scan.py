"""Inventories of directory trees, and content hashes, with a row for each failure."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesync.functions.globs import excluded
from treesync.functions.hashing import LENGTHS
from treesync.functions.paths import relative
from treesync.functions.shared import mounted, new_folder
from treesync.schemas import with_file_defaults

LISTED = "path string, kind string, size long, permissions int, modified_epoch long, error string"
COLUMNS = ["path", "kind", "size", "permissions", "modified_epoch", "error"]
#: Bytes read at once from a file.
CHUNK = 8 << 20


def inventory(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """FILES rows of a root on any file system that Spark reads, from metadata alone; a missing root is an error.

    Spark's reader leaves out empty files and names that begin with '_' or '.', and knows no permissions (0). For a
    mounted file system ``walk`` has them all.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified_epoch"))
    rel = relative(F.col("path"), root)
    return with_file_defaults(found.where(~excluded(rel, list(excludes))))


def _entry(entry: os.DirEntry, follow: bool) -> tuple | None:
    """The row of a directory entry; none for what is neither file nor directory."""
    path = entry.path
    try:
        path.encode()
    except UnicodeEncodeError:
        return path.encode(errors="surrogateescape").decode(errors="replace"), "error", None, None, None, "name is not UTF-8"
    try:
        meta = entry.stat(follow_symlinks=follow)
        if stat.S_ISDIR(meta.st_mode):
            if entry.is_symlink() and _loops(path):
                return path, "error", None, None, None, "symbolic link to a directory above"
            return path, "dir", None, None, None, None
    except OSError as e:
        return path, "error", None, None, None, str(e)
    return (path, "file", meta.st_size, meta.st_mode, int(meta.st_mtime // 1), None) if stat.S_ISREG(meta.st_mode) else None


def _loops(link: str) -> bool:
    """Whether a linked directory is one of those that its own path goes through."""
    target, above = os.path.realpath(link), os.path.dirname(link)
    while above != os.path.dirname(above):
        if os.path.realpath(above) == target:
            return True
        above = os.path.dirname(above)
    return target == "/"


def _lister(follow: bool):
    def entries(directory: str) -> Iterator[tuple]:
        try:
            with os.scandir(directory) as found:
                yield from filter(None, (_entry(e, follow) for e in found))
        except OSError as e:
            yield directory, "error", None, None, None, str(e)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        return out.astype({"size": "Int64", "permissions": "Int32", "modified_epoch": "Int64"})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for directory in batch["path"]:
                for row in entries(directory):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
        yield frame(rows)

    return listed


def walk(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), follow_symlinks: bool = True) -> DataFrame:
    """FILES and ``error`` of a tree on a file system that all executors mount: one row per regular file, empty and hidden ones too.

    Breadth first: a Spark job lists all directories of a level, so listing is spread over the executors and a directory
    of any size passes in bounded batches. What can't be listed or read is a row with ``error`` and no size, and the walk
    goes on; a missing root is an error. Excluded directories aren't entered. Links are followed unless they lead back to
    a directory above; else links are left out. Devices, sockets and pipes are left out.
    """
    top = mounted(root).rstrip("/") or "/"
    folder, level = new_folder(spark, "walk"), 0
    frontier = spark.createDataFrame([(top,)], "path string")
    tasks = spark.sparkContext.defaultParallelism * 4
    while True:
        listed = (frontier.repartition(tasks, "path") if level else frontier.coalesce(1)).mapInPandas(_lister(follow_symlinks), LISTED)
        keep = ~excluded(relative(F.col("path"), top), list(excludes)) | (F.col("path") == top)
        listed.where(keep).write.parquet(f"{folder}/level={level}")
        found = spark.read.schema(LISTED).parquet(f"{folder}/level={level}")
        if level == 0:
            for row in found.where((F.col("path") == top) & (F.col("kind") == "error")).limit(1).collect():
                raise FileNotFoundError(row["error"])
        frontier = found.where("kind = 'dir'").select("path")
        if frontier.isEmpty():
            break
        level += 1
    rows = spark.read.schema(LISTED + ", level int").parquet(folder).where("kind <> 'dir'").drop("kind", "level")
    return with_file_defaults(rows)


def _hasher(algorithm: str):
    if algorithm == "sha256":
        return hashlib.sha256
    if algorithm == "xxhash128":
        import xxhash

        return xxhash.xxh3_128
    if algorithm == "blake3":
        try:
            from blake3 import blake3
        except ImportError as e:
            raise ValueError("blake3 needs the blake3 package") from e
        return blake3
    raise ValueError(f"unknown algorithm {algorithm}; known are {', '.join(LENGTHS)}")


def hash_files(files: DataFrame, algorithm: str = "sha256", tasks: int | None = None, expected: str | None = None) -> DataFrame:
    """path, size, hash_algo, hash (hexadecimal), error of each row's ``path``; a file that can't be read has ``error`` and no hash.

    ``expected`` names a column of sizes: a file of another size isn't read and has its size, ``error`` and no hash.

    Files of any size are read in chunks, where they lie, so content never shuffles and memory doesn't grow with a file.
    Paths are those of a mounted file system, or URIs that Arrow opens. A null path is a failure. Repeated paths are hashed
    once a row. Rows are dealt by path, for a listing often has neighbours of like size.
    """
    _hasher(algorithm)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        new = _hasher(algorithm)
        for batch in batches:
            rows = []
            for path, want in zip(batch["path"], batch["expected"], strict=True):
                state, size = new(), 0
                try:
                    plain = mounted(path) if path.startswith(("/", "file:")) else None
                    at, name = (fs.LocalFileSystem(), plain) if plain else fs.FileSystem.from_uri(path)
                    if expected and (found := at.get_file_info(name)).type == fs.FileType.File and found.size != want:
                        rows.append((path, found.size, algorithm, None, "another size"))
                        continue
                    with at.open_input_stream(name, compression=None) as source:
                        while chunk := source.read(CHUNK):
                            state.update(chunk)
                            size += len(chunk)
                    rows.append((path, size, algorithm, state.hexdigest(), None))
                except (OSError, ValueError, AttributeError) as e:
                    rows.append((path, None, algorithm, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "size", "hash_algo", "hash", "error"]).astype({"size": "Int64"})

    n = tasks or files.sparkSession.sparkContext.defaultParallelism * 4
    size = F.col(expected) if expected else F.lit(None)
    return files.select("path", size.cast("long").alias("expected")).repartition(n, "path").mapInPandas(digests, "path string, size long, hash_algo string, hash string, error string")


# Huge files: chunks are hashed by themselves and meet in a tree of digests

LEAF, NODE, ROOT = b"\0", b"\1", b"\2"


def chunk_hashes(files: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """path, size, part, parts, hash, error: the SHA-256 of a zero byte and each ``chunk`` bytes of each file of ``files(path, size, ...)``.

    A row a chunk, dealt over all tasks, which read their ranges only; so a file of any size is read by many. An empty file has
    one empty chunk; unknown sizes have none, and a row with ``error``. A file that is shorter or longer than its size says is
    an error in the chunk that shows it. Repeated paths count once.
    """
    last = F.greatest(F.ceil(F.col("size") / chunk) - 1, F.lit(0)).cast("long")
    known = files.select("path", F.col("size").cast("long").alias("size")).dropDuplicates(["path"])
    parts = known.withColumn("part", F.explode(F.when(F.col("size").isNull() | F.col("path").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last))))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path, size, part in zip(batch["path"], batch["size"], batch["part"], strict=True):
                state, at, end = hashlib.sha256(LEAF), 0, 0
                try:
                    if part is None or pd.isna(part):
                        raise ValueError("unknown size or path")
                    at, end = int(part) * chunk, min((int(part) + 1) * chunk, int(size))
                    plain = mounted(path) if path.startswith(("/", "file:")) else None
                    on, name = (fs.LocalFileSystem(), plain) if plain else fs.FileSystem.from_uri(path)
                    with on.open_input_file(name) as source:
                        if source.size() != size:
                            raise ValueError(f"has {source.size()} bytes")
                        source.seek(at)
                        while at < end:
                            data = source.read(min(CHUNK, end - at))
                            if not data:
                                raise ValueError("ends early")
                            state.update(data)
                            at += len(data)
                    rows.append((path, size, part, state.hexdigest(), None))
                except (OSError, ValueError) as e:
                    rows.append((path, size, part, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "size", "part", "hash", "error"]).astype({"size": "Int64", "part": "Int64"})

    n = files.sparkSession.sparkContext.defaultParallelism * 4
    return parts.repartition(n, "path", "part").mapInPandas(digests, "path string, size long, part long, hash string, error string").withColumn("parts", F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("long"))


def tree_hash(chunks: DataFrame, fanout: int = 256) -> DataFrame:
    """path, size, hash, error of files whose ``chunks`` are staged ``chunk_hashes``: the digest of a tree over them.

    A node is the SHA-256 of a one byte and its children's digests in order, up to ``fanout`` of them; levels go on until one node is
    left. The file's digest is that of a two byte, its size in eight bytes, and that node. So a file of any size takes no large
    group. A file with a failed chunk has an error and no hash.
    """
    failed = chunks.where("error is not null").groupBy("path").agg(F.min("size").alias("size"), F.min("error").alias("error"))
    level = chunks.where("error is null").join(failed.select("path"), "path", "left_anti").select("path", "size", "part", "parts", "hash")
    most = level.agg(F.max("parts").alias("n")).first()["n"] or 1
    join = lambda *hexes: F.sha2(F.unhex(F.concat(*hexes)), 256)
    tops = []
    while True:
        tops.append(level.where("parts = 1"))
        if most == 1:
            break
        children = F.array_sort(F.collect_list(F.struct("part", "hash")))
        nodes = level.where("parts > 1").groupBy("path", "size", F.ceil(F.col("parts") / fanout).alias("above"), F.floor(F.col("part") / fanout).alias("node")).agg(F.array_join(F.transform(children, lambda c: c["hash"]), "").alias("hash"))
        level, most = nodes.select("path", "size", F.col("node").alias("part"), F.col("above").alias("parts"), join(F.lit(NODE.hex()), "hash").alias("hash")), -(-most // fanout)
    top = reduce(DataFrame.unionByName, tops)
    root = top.select("path", "size", join(F.lit(ROOT.hex()), F.lpad(F.hex("size"), 16, "0"), "hash").alias("hash"), F.lit(None).cast("string").alias("error"))
    return root.unionByName(failed.select("path", "size", F.lit(None).cast("string").alias("hash"), "error"))


def changed_chunks(old: DataFrame, new: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """path, part, start: where two lists of chunk hashes of the same paths differ, chunks that only one has included; files of unknown size have none."""
    sides = [x.where("path is not null and part is not null").select("path", "part", F.col("hash").alias(name), F.lit(True).alias(f"in_{name}")) for x, name in ((old, "a"), (new, "b"))]
    both = sides[0].join(sides[1], ["path", "part"], "full").where("in_a is null or in_b is null or not (a <=> b)")
    return both.select("path", "part", (F.col("part") * chunk).alias("start"))

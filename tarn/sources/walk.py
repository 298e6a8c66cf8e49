"""A folder walk as a Python data source, and readers that stream what it finds (SRC-1, SRC-2, SRC-8, SRC-17, HASH-4).

Spark's own readers pass over empty files and over names that begin with a dot or an
underscore; the walk sees every entry.  Subtrees are partitions: the driver lists folders,
breadth first, only until there are enough of them, and tasks walk what is below.  A folder
is one that every executor can open, such as a mounted share.
"""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Subtrees that a walk is cut into at least, where there are so many; entries of a batch; bytes that are hashed at once.
SUBTREES = 64
ENTRIES = 4096
BLOCK = 1 << 20
#: Bytes that are read at once from a log's end.
TAIL_BLOCK = 64 << 10
#: Bytes of contents in a batch.
CONTENTS = 16 << 20

SCHEMA = "path string, relative_path string, name string, size long, modified_at timestamp, depth int, skipped string"
_ARROW = pa.schema([("path", pa.string()), ("relative_path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("depth", pa.int32()), ("skipped", pa.string())])


@dataclass
class Subtree(InputPartition):
    folder: str
    depth: int
    below: bool  # whether the folders in it are walked too


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.realpath(options["path"])
        self.ignored = frozenset(json.loads(options.get("ignored", "[]")))
        self.most = int(options.get("depth", "20"))
        self.subtrees = int(options.get("subtrees", str(SUBTREES)))

    def _entries(self, folder: str) -> list[os.DirEntry] | None:
        try:
            with os.scandir(folder) as found:
                return list(found)
        except OSError:
            return None

    def _kind(self, entry: os.DirEntry, depth: int) -> tuple[str | None, os.stat_result | None]:
        """Why an entry is left out (None: it is a file; "": a folder to walk), and its metadata."""
        try:
            seen = entry.stat(follow_symlinks=False)
        except OSError:
            return "unreadable", None
        if stat.S_ISLNK(seen.st_mode):
            return "link", seen
        if stat.S_ISDIR(seen.st_mode):
            return ("ignored_directory" if entry.name.lower() in self.ignored else "too_deep" if depth + 1 > self.most else ""), seen
        return (None if stat.S_ISREG(seen.st_mode) else "not_a_file"), seen

    def partitions(self) -> list[Subtree]:
        waiting, listed = [(self.root, 0)], []
        while waiting and len(waiting) + len(listed) < self.subtrees:
            folder, depth = waiting.pop(0)
            listed.append(Subtree(folder, depth, False))
            for entry in self._entries(folder) or ():
                if self._kind(entry, depth)[0] == "":
                    waiting.append((entry.path, depth + 1))
        return [*listed, *(Subtree(f, d, True) for f, d in waiting)]

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        stack = [(partition.folder, partition.depth)]
        while stack:
            folder, depth = stack.pop()
            entries = self._entries(folder)
            if entries is None:
                rows.append(self._row(folder, depth, "unreadable", None))
            for entry in entries or ():
                skipped, seen = self._kind(entry, depth)
                if skipped != "":
                    rows.append(self._row(entry.path, depth, skipped, seen))
                elif partition.below:
                    stack.append((entry.path, depth + 1))
                if len(rows) >= ENTRIES:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _row(self, path: str, depth: int, skipped: str | None, seen: os.stat_result | None) -> tuple:
        plain = os.fsencode(path).decode("utf-8", "replace")
        return plain, os.path.relpath(plain, self.root), os.path.basename(plain), seen and seen.st_size, seen and seen.st_mtime_ns // 1000, depth, skipped

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class FolderWalk(DataSource):
    """Options: path; ignored, a JSON list of lower-case folder names that are not entered; depth; subtrees."""

    @classmethod
    def name(cls) -> str:
        return "folder_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> WalkReader:
        return WalkReader(dict(self.options))


def local_path(folder: str) -> str:
    return "/" + folder.split(":", 1)[1].lstrip("/") if folder.startswith("file:") else folder


def walk(spark: SparkSession, folder: str, ignored: list[str] | None = None, depth: int = 20) -> DataFrame:
    """SRC-2, SRC-8: (path, relative_path, name, size, modified_at, depth, skipped) of every file below a folder and of every entry left out.

    ``skipped`` is null for files, else link, ignored_directory, too_deep, not_a_file or
    unreadable.  Links are not followed; what lies in a folder that is left out has no rows.
    A root that cannot be read is one unreadable row.
    """
    spark.dataSource.register(FolderWalk)
    return spark.read.format("folder_walk").option("ignored", json.dumps(ignored or [])).option("depth", str(depth)).load(local_path(folder))


def contents(files: DataFrame) -> DataFrame:
    """(path, content, error) of the rows (path); a file that cannot be read is a row with its error. Callers filter by size before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(path, "rb") as f:
                        rows.append((path, f.read(), None))
                except OSError as e:
                    rows.append((path, None, type(e).__name__))
                size += len(rows[-1][1] or b"")
                if size >= CONTENTS:
                    yield _table(rows)
                    rows, size = [], 0
        if rows:
            yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string()), strict=True)], names=["path", "content", "error"])

    return files.select("path").mapInArrow(run, "path string, content binary, error string")


def digests(files: DataFrame) -> DataFrame:
    """HASH-4: (path, size, sha256, error) of the rows (path), read in blocks: a content of any size is never a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                made, size, error = hashlib.sha256(), 0, None
                try:
                    with open(path, "rb", buffering=0) as f:
                        while block := f.read(BLOCK):
                            made.update(block)
                            size += len(block)
                except OSError as e:
                    error = type(e).__name__
                found = [[path], [None if error else size], [None if error else made.hexdigest()], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "size", "sha256", "error"])

    # Large files lie side by side in a folder, so paths are dealt out by their hash.
    return files.select("path").repartition("path").mapInArrow(run, "path string, size long, sha256 string, error string")


def last_lines(path: str, lines: int, block: int = TAIL_BLOCK) -> list[str]:
    """The last lines that are not blank, trimmed, the newest first; blocks are read from the end until there are enough."""
    found: list[str] = []
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        rest: list[bytes] = []  # the blocks of the line whose start is not read yet, the last first
        while at > 0 and len(found) < lines:
            size = min(block, at)
            at -= size
            f.seek(at)
            first, *whole = f.read(size).split(b"\n")
            if whole:
                whole[-1] += b"".join(reversed(rest))
                found += [t for x in reversed(whole) if (t := x.decode("utf-8", "replace").strip())]
                rest = [first]
            else:
                rest.append(first)
        if at == 0 and (t := b"".join(reversed(rest)).decode("utf-8", "replace").strip()):
            found.append(t)
    return found[:lines]


def tails(files: DataFrame, lines: int = 200) -> DataFrame:
    """SRC-17: (path, back, line, error) of the last lines of every file (path); ``back`` is 0 for the newest.

    What is read of a file does not grow with it.  Blank lines do not count, bytes that are no
    UTF-8 are replaced, a last line needs no end.  A file that cannot be read is one row with
    its error; an empty one has no rows.
    """
    if lines < 1:
        raise ValueError("at least one line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, error = [], None
                try:
                    found = last_lines(path, lines)
                except OSError as e:
                    found, error = [None], type(e).__name__
                n = len(found)
                columns = [[path] * n, [None if error else k for k in range(n)], found, [error] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "back", "line", "error"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, back int, line string, error string")


def feeds(files: DataFrame, schema: str, limit: int = 100, lines: int = 200) -> DataFrame:
    """SRC-17, DIA-13: (path, position, record) of every log's last lines that parse, the newest first, at most ``limit`` of each. A limit that is not from 1 to ``lines`` is 100."""
    limit = limit if 1 <= limit <= lines else 100
    good = tails(files, lines).where("error is null").where(F.try_parse_json("line").isNotNull())
    ranked = good.withColumn("position", F.row_number().over(Window.partitionBy("path").orderBy("back")))
    return ranked.where(F.col("position") <= limit).select("path", "position", F.from_json("line", schema).alias("record"))


def inventory(spark: SparkSession, folder: str, ignored: list[str], sensitive, depth: int = 20) -> DataFrame:
    """SRC-2: the walk with sensitive names left out too. ``sensitive`` makes a predicate of the name's column."""
    found = walk(spark, folder, ignored, depth)
    return found.withColumn("skipped", F.coalesce("skipped", F.when(sensitive(F.col("name")), "sensitive_name")))


def summary(found: DataFrame) -> DataFrame:
    """SRC-2, AGG-5: one row (files, bytes, skipped_count, error_count, truncated) of an inventory."""
    unreadable = F.col("skipped") == "unreadable"
    return found.agg(
        F.count_if(F.col("skipped").isNull()).alias("files"),
        F.coalesce(F.sum(F.when(F.col("skipped").isNull(), F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("skipped").isNotNull() & ~unreadable).alias("skipped_count"),
        F.count_if(unreadable).alias("error_count"),
        F.coalesce(F.bool_or(F.col("skipped") == "too_deep"), F.lit(False)).alias("truncated"),
    )

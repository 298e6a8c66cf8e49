"""Tables whose versions are published atomically (SRC-12 to SRC-15, MEM-5, VEC-9, VEC-12)."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


class Conflict(RuntimeError):
    """Another writer has published meanwhile."""


class VersionedTable:
    """Versions are whole folders; generation n is the one small file that names the n-th version.

    A version is written in full first.  Then the next generation's file is created
    exclusively: of writers that race for a number one creates it and the others are told, so
    nobody's publication is lost unseen.  The file gets its name with its content complete, by
    a link on a local disk and by a rename that never replaces elsewhere, so readers see the
    old generation or the new one.  The live generation is the largest number in a listing.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- the folder, through Hadoop's file systems

    def _path(self, name: str) -> object:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self) -> object:
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[tuple[str, int]]:
        """(name, time in ms) of a folder's entries."""
        fs, path = self._fs(), self._path(name)
        return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def _create(self, name: str, body: str) -> bool:
        """Create a file with its content, unless there is one of the name; whether it was created."""
        fs, draft = self._fs(), self._path(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(body.encode())
        out.close()
        target = self._path(name)
        fs.mkdirs(target.getParent())
        if fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            finally:
                fs.delete(draft, False)
            return True
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # -- generations

    def _generation(self, number: int) -> dict:
        out = self.spark.sparkContext._jvm.java.io.ByteArrayOutputStream()
        stream = self._fs().open(self._path(f"generations/{number:012d}"))
        self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 4096, True)
        return json.loads(bytes(out.toByteArray()).decode())

    def head(self) -> dict | None:
        """The live generation: generation, version, model."""
        numbers = [int(name) for name, _ in self._listed("generations") if name.isdigit()]
        return self._generation(max(numbers)) if numbers else None

    def publish(self, rows: DataFrame, model: str, expected: int | None = None) -> int:
        """Write a version and make it the live one; its generation.

        With ``expected`` the table must still be at that generation, else ``Conflict`` is
        raised and the version is dropped; without it the next free number is taken.
        """
        head = self.head()
        at = head["generation"] if head else 0
        if expected is not None and expected != at:
            raise Conflict(f"the table is at generation {at}, not {expected}")
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/versions/{version}")
        while True:
            at += 1
            if self._create(f"generations/{at:012d}", json.dumps({"generation": at, "version": version, "model": model})):
                return at
            if expected is not None:
                self._fs().delete(self._path(f"versions/{version}"), True)
                raise Conflict(f"another writer published generation {at}")

    def update(self, change: Callable[[DataFrame | None], DataFrame], model: str, tries: int = 2) -> int:
        """MEM-5: publish what ``change`` makes of the live version, again from the new one if another writer was first."""
        for left in range(tries - 1, -1, -1):
            head = self.head()
            try:
                return self.publish(change(self._version(head) if head else None), model, head["generation"] if head else 0)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 or more")

    def _version(self, head: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/versions/{head['version']}")

    def _live(self, model: str | None) -> tuple[dict, DataFrame]:
        for again in (True, False):
            head = self.head()
            if head is None:
                raise FileNotFoundError(f"{self.folder} holds no table")
            if model is not None and head["model"] != model:
                raise ValueError(f"the index was made with {head['model']}, not {model}")
            try:
                return head, self._version(head)
            except AnalysisException as e:  # the version was dropped after its generation was read
                if not again or e.getCondition() != "PATH_NOT_FOUND":
                    raise
        raise AssertionError

    def read(self, model: str | None = None) -> DataFrame:
        """The live version; an index made with another model is refused."""
        return self._live(model)[1]

    def query(self, ask: Callable[[DataFrame], T], model: str | None = None) -> T:
        """VEC-9: an answer from one generation: if another is published while ``ask`` runs, it is asked once more, then refused."""
        for _ in range(2):
            head, rows = self._live(model)
            answer = ask(rows)
            if self.head() == head:
                return answer
        raise Conflict("the table was published again while it was read twice")

    def drop_versions(self, keep: int = 2, orphans_after: float = 86_400.0) -> int:
        """Drop all but the ``keep`` newest generations with their versions, and versions without a generation older than so many seconds; how many went."""
        numbers = sorted(int(name) for name, _ in self._listed("generations") if name.isdigit())
        old, kept = numbers[: -max(keep, 1)], numbers[-max(keep, 1) :]
        gone = {self._generation(n)["version"] for n in old} - (named := {self._generation(n)["version"] for n in kept})
        late = (time.time() - orphans_after) * 1000
        gone |= {name for name, at in self._listed("versions") if name not in named and at < late}
        for name in [*(f"generations/{n:012d}" for n in old), *(f"versions/{v}" for v in gone)]:
            self._fs().delete(self._path(name), True)
        return len(gone)

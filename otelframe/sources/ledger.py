"""Changes of a table of plain files that happen as a whole, once, whatever breaks off.

A change is staged first: its new files lie in a folder of their own. Then one record is
renamed into the ledger, and with that the change has happened: it lists the files to
move into the table, the files that they replace and, for a stream, the batch. Moving and
deleting come after; who finds a record that is still open, reader or writer, can tell
what the table holds, and a writer finishes it. What broke off before its record was
written has not happened.

For each stream one empty marker tells the last batch that is in the table, so that a
batch which comes again is known, whatever has been made of its files since.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import SparkSession

#: Threads that rename and delete files.
AT_ONCE = 16
#: Staged folders without a record are given up after this many seconds.
FORGOTTEN = 24 * 3600


class Change(NamedTuple):
    name: str
    staged: str
    moves: list[list[str]]
    replaced: list[str]
    batch: str | None = None
    number: int | None = None


class Files:
    """The file system of a path, as far as a ledger needs it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(path))] if self.exists(path) else []

    def matching(self, pattern: str) -> list[str]:
        """Paths that a pattern names, in one call to the file system."""
        return [s.getPath().toString() for s in self.fs.globStatus(self._path(pattern)) or []]

    def age(self, path: str) -> float:
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def make_folder(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def rename(self, source: str, target: str) -> bool:
        return self.fs.rename(self._path(source), self._path(target))

    def write(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        source = self.fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()


def each(act: Callable, items: Iterable) -> None:
    """``act`` on every item, some at a time; the first error is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(act, items))


class Ledger:
    """The changes of one table (``root``/``signal``)."""

    def __init__(self, spark: SparkSession, root: str, signal: str):
        self.files = Files(spark, root)
        self.folder = f"{root}/.ledger/{signal}"
        self.stages = f"{root}/.staged/{signal}"

    def stage(self, name: str) -> str:
        """The folder in which a change's new files are put."""
        return f"{self.stages}/{name}"

    def open_changes(self) -> list[Change]:
        """Changes that have happened and are not finished."""
        names = [n for n in self.files.names(self.folder) if n.startswith("open-")]
        return [Change(**json.loads(self.files.read(f"{self.folder}/{n}"))) for n in sorted(names)]

    def last(self, stream: str) -> int:
        """The last batch of a stream that is in the table, -1 if there is none."""
        start = f"last-{stream}-"
        return max((int(n[len(start) :]) for n in self.files.names(self.folder) if n.startswith(start)), default=-1)

    def record(self, change: Change) -> None:
        """From here on the change has happened."""
        self.files.make_folder(self.folder)
        written = f"{self.folder}/.new-{uuid.uuid4().hex}"
        self.files.write(written, json.dumps(change._asdict()))
        if not self.files.rename(written, self._open(change)):
            raise OSError(f"cannot write {self._open(change)}")

    def _open(self, change: Change) -> str:
        return f"{self.folder}/open-{change.name}"

    def finish(self, change: Change) -> None:
        """Move, delete, mark the batch, close the record. Each step may have been done."""
        each(self.files.make_folder, {target.rpartition("/")[0] for _, target in change.moves})

        def move(pair: list[str]) -> None:
            source, target = pair
            if self.files.exists(source):
                self.files.rename(source, target)
            elif not self.files.exists(target):
                raise OSError(f"neither {source} nor {target} is there")

        each(move, change.moves)
        each(self.files.delete, change.replaced)
        if change.batch is not None:
            before = self.last(change.batch)
            if before < change.number:
                self.files.write(f"{self.folder}/last-{change.batch}-{change.number}", "")
                if before >= 0:
                    self.files.delete(f"{self.folder}/last-{change.batch}-{before}")
        self.files.delete(change.staged)
        self.files.delete(self._open(change))

    def recover(self, maintenance: bool = False) -> None:
        """Finish what has happened; give up old staged folders, and with ``maintenance``
        those of earlier compactions (only one runs at a time)."""
        changes = self.open_changes()
        for change in changes:
            self.finish(change)
        for name in self.files.names(self.stages):
            if (maintenance and name.startswith("compact-")) or self.files.age(f"{self.stages}/{name}") > FORGOTTEN:
                self.files.delete(f"{self.stages}/{name}")

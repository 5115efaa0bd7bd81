"""Tables that several writers change at once: data in folders of their own, and a marker per version that only one writer can create.

A version is a JSON object of slots, each with the folder that holds its rows. A change reads the newest version, writes its rows to a fresh folder, and then creates the next marker exclusively:
whoever comes second finds the marker there, reads what came between, and tries again. A writer that is lost leaves a folder that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

#: Tries to commit before a change is given up, and folders from which an append gathers all rows into one.
TRIES, FOLDERS = 50, 100


class Conflict(RuntimeError):
    """A change met other writers at every try."""


class VersionedTable:
    """A table under `path`, on a local or shared disk or a file system whose rename doesn't replace a file."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _marker(self, version: int) -> str:
        return f"{self.path}/_versions/{version:012d}.json"

    def version(self) -> int:
        """The newest version, 0 before the first change."""
        folder = self._hadoop(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:12]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def slots(self, version: int) -> dict[str, str]:
        """Slots of a version and their folders, relative to the table."""
        if not version:
            return {}
        stream = self._fs.open(self._hadoop(self._marker(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def rows(self, folders: Iterable[str]) -> DataFrame:
        """The rows of some folders; none gives an empty table."""
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        slots = self.slots(self.version() if version is None else version)
        return self.rows(v for k, v in slots.items() if not k.startswith("_"))

    def write(self, rows: DataFrame, by: str | None = None) -> str:
        """Write rows to a folder that no version names yet, with a sub-folder for each value of `by`."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{folder}")
        return folder

    def folders(self, folder: str, by: str) -> list[str]:
        """The values of `by` that a folder of write() has rows of."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(f"{self.path}/{folder}"))]
        return [n.removeprefix(f"{by}=") for n in names if n.startswith(f"{by}=")]

    def discard(self, folder: str) -> None:
        self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)

    def commit(self, base: int, slots: dict[str, str]) -> bool:
        """Make `slots` the version after `base`, unless another writer has made one."""
        draft, marker = self._hadoop(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self._hadoop(self._marker(base + 1))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(slots, sort_keys=True).encode()))
        stream.close()
        try:
            if self._fs.exists(marker):
                return False
            if self._fs.getScheme() == "file":  # a local rename replaces files, a link doesn't
                files, file = self._jvm.java.nio.file.Files, lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    files.createLink(file(marker), file(draft))
                except Exception as refused:
                    if "FileAlreadyExists" in str(refused):
                        return False
                    raise
                return True
            return self._fs.rename(draft, marker)
        finally:
            self._fs.delete(draft, False)

    def append(self, pending: DataFrame, fresh: Callable[[DataFrame, DataFrame], DataFrame], tries: int = TRIES) -> int:
        """Add those pending rows that fresh(pending, rows of the table) leaves, and return how many; a repeated append adds none.

        After a conflict only the rows of the versions between are looked at again. What was written is read back and counted before it's committed.
        """
        base, seen = 0, set()
        folder = None
        for _ in range(tries):
            version = self.version()
            slots = self.slots(version)
            unseen = [f for k, f in slots.items() if k not in seen]
            if folder is None:
                folder = self.write(fresh(pending, self.rows(unseen)))
            elif unseen:
                last, folder = folder, self.write(fresh(self.rows([folder]), self.rows(unseen)))
                self.discard(last)
            base, seen = version, set(slots)
            written = self.rows([folder]).count()
            if not written:
                self.discard(folder)
                return 0
            if self.commit(base, slots | {uuid.uuid4().hex: folder}):
                if len(slots) >= FOLDERS:
                    self.mutate(lambda rows: rows)
                return written
        raise Conflict(f"{tries} tries to append to {self.path}")

    def mutate(self, change: Callable[[DataFrame], DataFrame], tries: int = TRIES) -> int:
        """Replace all rows by change(rows), one writer after the other: a change that another one came before is made anew on its result. Returns the new version."""
        for _ in range(tries):
            base = self.version()
            folder = self.write(change(self.read(base)))
            if self.commit(base, {uuid.uuid4().hex: folder}):
                return base + 1
            self.discard(folder)
        raise Conflict(f"{tries} tries to change {self.path}")

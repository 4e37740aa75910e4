"""Versioned tables: a folder for each epoch and a marker once it is whole.

A writer fills ``<path>/epoch=<n>`` completely and then creates the empty file ``_done=<n>``, in
one step on any store. The greatest marker points to the current table, so a reader never sees an
empty or half-written one, and an epoch that is written again after a failure changes nothing once
its marker is there. File operations go through the Hadoop file system of the path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARKER = "_done="


class Folder:
    """File operations on one folder through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def mark(self, name: str) -> None:
        self._fs.mkdirs(self._at(""))
        self._fs.create(self._at(name), True).close()


class Snapshots:
    """A table at ``path`` that is replaced as a whole, epoch by epoch. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        if keep < 1:
            raise ValueError("keep at least the current epoch")
        self.spark, self.keep, self.folder = spark, keep, Folder(spark, path)

    def epochs(self) -> list[int]:
        """Epochs that are whole, in order."""
        return sorted(int(n[len(MARKER):]) for n in self.folder.names() if n.startswith(MARKER))

    def current(self) -> int | None:
        return max(self.epochs(), default=None)

    def path_of(self, epoch: int) -> str:
        return f"{self.folder.path}/epoch={epoch}"

    def read(self) -> DataFrame | None:
        """The current table, or None before the first epoch."""
        epoch = self.current()
        return None if epoch is None else self.spark.read.parquet(self.path_of(epoch))

    def write(self, df: DataFrame, epoch: int) -> bool:
        """Makes ``df`` the table of ``epoch``; False if that epoch or a later one is there already.

        ``df`` may read the current epoch. The last ``keep`` epochs stay for readers that hold one."""
        now = self.current()
        if now is not None and now >= epoch:
            return False
        df.write.mode("overwrite").parquet(self.path_of(epoch))
        self.folder.mark(f"{MARKER}{epoch}")
        self.forget()
        return True

    def forget(self) -> None:
        """Removes epochs before the last ``keep``, the marker first."""
        for old in self.epochs()[:-self.keep]:
            self.folder.remove(f"{MARKER}{old}")
            self.folder.remove(f"epoch={old}")

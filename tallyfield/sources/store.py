"""The season store: one folder of Parquet files for each season, replaced as a whole.

New seasons are first written to a hidden folder within the store. Then a journal is put in place
with one rename: from that moment on the new seasons count, and ``read`` takes them from where they
are, the hidden folder or the season's own. Their folders are moved, then the old ones and the
journal are removed. A writer that fails before the journal leaves nothing that counts; one that
fails after it is completed by the next writer. ``read`` changes nothing.

Plain readers of the folder see whole seasons as well, but may miss one between two renames.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

HIDDEN, JOURNAL = "_swap-", "_journal"


class Folder:
    """A few calls of the file system that Spark itself writes with."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "", start: str = "") -> list[str]:
        found = [x.getPath().getName() for x in self.fs.listStatus(self.path(name))] if self.exists(name) else []
        return sorted(x for x in found if x.startswith(start))

    def move(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} couldn't be moved to {new} in {self.root}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))


def pending(folder: Folder) -> str | None:
    """The hidden folder whose seasons count but aren't all moved yet."""
    return next((h for h in folder.names(start=HIDDEN) if folder.exists(f"{h}/{JOURNAL}")), None)


def settle(folder: Folder) -> None:
    """Completes what a failed writer has begun to switch, and removes what it has only staged."""
    if hidden := pending(folder):
        for season in folder.names(f"{hidden}/new", "season="):
            if folder.exists(season):
                folder.make(f"{hidden}/old")
                folder.move(season, f"{hidden}/old/{season}")
            folder.move(f"{hidden}/new/{season}", season)
    for other in folder.names(start=HIDDEN):
        folder.remove(other)


def replace_seasons(games: DataFrame, path: str) -> None:
    """One writer at a time."""
    folder, hidden = Folder(games.sparkSession, path), f"{HIDDEN}{uuid.uuid4().hex}"
    try:
        games.write.partitionBy("season").parquet(f"{folder.root}/{hidden}/new")  # may still read a pending switch
        stale = [h for h in folder.names(start=HIDDEN) if h != hidden]
        if pending(folder):  # of a writer that failed: first complete it, but for what is new now
            folder.move(hidden, f"{hidden[1:]}.kept")
            settle(folder)
            folder.move(f"{hidden[1:]}.kept", hidden)
        for other in stale:
            folder.remove(other)
        folder.make(f"{hidden}/{JOURNAL}")
    except BaseException:
        if not folder.exists(f"{hidden}/{JOURNAL}"):
            folder.remove(hidden)
        raise
    settle(folder)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with ``season``; an error if there is no store."""
    folder = Folder(spark, path)
    hidden = pending(folder)
    new = folder.names(f"{hidden}/new", "season=") if hidden else []
    if not new:
        return spark.read.parquet(path)
    parts = [spark.read.option("basePath", f"{path}/{hidden}/new").parquet(*[f"{path}/{hidden}/new/{s}" for s in new])]
    if old := [s for s in folder.names(start="season=") if s not in new]:
        parts.append(spark.read.option("basePath", path).parquet(*[f"{path}/{s}" for s in old]))
    return reduce(DataFrame.unionByName, parts)

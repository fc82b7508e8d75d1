"""Numbered checkpoints of a build: which stages are done, and where to go on."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

NAME = re.compile(r"checkpoint_([0-9]+)_(.+)\.cp")


class Checkpoints:
    """Markers checkpoint_N_title.cp in a folder that Spark's file systems reach; a stage's data is written before its marker."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark._jvm
        self.folder, self._path = folder, jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, number: int, title: str):
        return self._path(f"{self.folder}/checkpoint_{number}_{title}.cp")

    def done(self) -> dict[int, str]:
        """Number and title of each marker."""
        if not self.fs.exists(self._path(self.folder)):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return {int(m[1]): m[2] for n in names if (m := NAME.fullmatch(n))}

    def state(self) -> str:
        """'empty' without markers, 'bad' if one before another is missing, else 'data'."""
        numbers = sorted(self.done())
        return "empty" if not numbers else "data" if numbers == list(range(len(numbers))) else "bad"

    def repair(self) -> int:
        """Remove the markers after a gap; the number of the stage to go on with."""
        found = self.done()
        first = next(i for i in range(len(found) + 1) if i not in found)
        for n, title in found.items():
            if n > first:
                self.fs.delete(self._at(n, title), False)
        return first

    def mark(self, number: int, title: str, data: str = "") -> None:
        """Write a marker whose content is kept for the next run (what was finished so far, say)."""
        out = self.fs.create(self._at(number, title), True)
        out.write(bytearray(data.encode()))
        out.close()

    def read(self, number: int) -> str | None:
        """What a marker holds; None if it is missing."""
        title = self.done().get(number)
        if title is None:
            return None
        stream = self.fs.open(self._at(number, title))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def clear(self) -> None:
        """Remove all markers."""
        for n, title in self.done().items():
            self.fs.delete(self._at(n, title), False)


def purge(spark: SparkSession, folder: str, names: tuple[str, ...]) -> list[str]:
    """Delete these folders below `folder`, and nothing outside it; what was deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for n in names:
        if not re.fullmatch(r"\w[\w.-]*", n):
            raise ValueError(f"{n!r} is no name of a folder here")
        if fs.delete(path(f"{folder}/{n}"), True):
            gone.append(n)
    return gone

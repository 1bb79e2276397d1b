"""Versions of a stored thing: numbered JSON files, of which the highest counts.

Whoever commits writes its data files first, under names of their own, and then
one manifest that names all files that count. A reader takes the highest manifest
there is, so it sees all of a commit or nothing of it, and never no store: no
manifest is changed or deleted by a commit. One writer at a time; a second one
that commits the same number gets an error.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

from docloom.plans.shared import delete


class Manifest:
    """The manifests of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _system(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The numbers of all commits, ascending."""
        folder = self._path("manifest")
        if not self._system().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._system().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict[str, Any]]:
        """(number, content) of a commit, by default the last one; (0, {}) before the first."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        return number, json.loads(self.spark.read.text(f"{self.root}/manifest/{number:09d}.json", wholetext=True).first()[0])

    def publish(self, number: int, content: dict[str, Any]) -> None:
        """Commit ``number`` (one more than the last). FileExistsError if it is there already."""
        system, final = self._system(), self._path(f"manifest/{number:09d}.json")
        temporary = self._path(f"manifest/.{number:09d}-{uuid.uuid4().hex}")
        out = system.create(temporary, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if system.exists(final) or not system.rename(temporary, final):
            system.delete(temporary, False)
            raise FileExistsError(f"commit {number} of {self.root} is taken")

    def forget(self, keep: int, folders: Any) -> None:
        """Delete all but the last ``keep`` commits, and the data folders (``folders(content)``) that only those name."""
        numbers = self.numbers()
        gone, kept = numbers[:-keep], numbers[-keep:]
        still = {f for n in kept for f in folders(self.read(n)[1])}
        for number in gone:
            for folder in set(folders(self.read(number)[1])) - still:
                delete(self.spark, f"{self.root}/{folder}")
            delete(self.spark, f"{self.root}/manifest/{number:09d}.json")

"""The state of a table or an index as numbered JSON files, each put in place by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """States in a folder of any file system that Spark reaches; the one of the largest number is in force."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self._jvm = folder, spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, number: int):
        return self._path(f"{self.folder}/{number:09d}.json")

    def numbers(self) -> list[int]:
        folder = self._path(self.folder)
        if not self.system.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.system.open(self._file(number))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict | None]:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (-1, None)

    def commit(self, state: dict, after: int) -> int:
        """Puts the state in force that was made from number `after`; OSError if another has come since."""
        made = self._path(f"{self.folder}/_{uuid.uuid4().hex}")
        stream = self.system.create(made)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        place = self._file(after + 1)
        if self.system.exists(place) or not self.system.rename(made, place):
            self.system.delete(made, False)
            raise OSError(f"another change came first: {place.toString()}")
        return after + 1

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.system.delete(self._file(n), False)

    def delete(self, path: str) -> bool:
        return bool(self.system.delete(self._path(path), True))

    def names(self, path: str) -> list[str]:
        at = self._path(path)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

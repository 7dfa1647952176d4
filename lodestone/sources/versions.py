"""Numbered descriptions of a folder of data: what belongs to it is what the latest one lists."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer made the version that was to be made."""


class Versions:
    """Files v-<number>.json in a folder of any file system that Spark reaches. A version is written aside and renamed to its name, which fails where that
    name is taken; so one of several writers makes it, readers see a version whole or not at all, and data files that no version lists are not read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._folder = self._hadoop.fs.Path(self.path)

    def _context(self):
        return self._hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration())

    def _system(self):
        return self._folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        system = self._system()
        if not system.exists(self._folder):
            return []
        names = [x.getPath().getName() for x in system.listStatus(self._folder)]
        return sorted(int(x[2:-5]) for x in names if x.startswith("v-") and x.endswith(".json"))

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """(number, description) of a version, by default the latest; (0, {}) where there is none."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        stream = self._system().open(self._hadoop.fs.Path(f"{self.path}/v-{number:010d}.json"))
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, described: dict) -> int:
        """Makes version `number`; Conflict if it is there already."""
        system, aside = self._system(), self._hadoop.fs.Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = system.create(aside)
        out.write(bytearray(json.dumps(described).encode()))
        out.close()
        try:
            options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
            self._context().rename(aside, self._hadoop.fs.Path(f"{self.path}/v-{number:010d}.json"), options)
        except Exception as e:
            system.delete(aside, False)
            if self._system().exists(self._hadoop.fs.Path(f"{self.path}/v-{number:010d}.json")):
                raise Conflict(f"{self.path}: version {number} is there already") from e
            raise
        return number

    def folders(self, name: str) -> list[str]:
        """Names of what lies in a folder below this one."""
        return sorted(x.getPath().getName() for x in self._system().listStatus(self._hadoop.fs.Path(f"{self.path}/{name}")))

    def remove(self, names: list[str]) -> None:
        """Deletes folders or files that no version needs any more."""
        for name in names:
            self._system().delete(self._hadoop.fs.Path(f"{self.path}/{name}"), True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table: another one after any write to it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, found = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if system.getFileStatus(at).isFile():
        status = system.getFileStatus(at)
        found.append((path, status.getLen(), status.getModificationTime()))
    else:
        files = system.listFiles(at, True)
        while files.hasNext():
            status = files.next()
            found.append((str(status.getPath().toString()), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([path, sorted(found)]).encode()).hexdigest()[:32]

"""Versions of tables under one folder: data are written to folders of their own and never changed; a version exists once its
entry does. An entry is written beside its place and renamed into it without overwriting, so of two writers of one version one
fails, and a writer that dies before the rename leaves only data that nobody reads (prune() removes them)."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Taken(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Versions:
    """root/entries/<number>.json and root/data/<id>. root: any folder that Spark's file systems reach."""

    spark: SparkSession
    root: str

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root.rstrip("/"), *parts)))

    def _fs(self):
        return self._path("entries").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        fs, at = self._fs(), self._path("entries")
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(at) if x.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def entry(self, number: int) -> dict:
        stream = self._fs().open(self._path("entries", f"{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, entry) of the newest version; (0, {}) if there is none."""
        found = self.numbers()
        return (found[-1], self.entry(found[-1])) if found else (0, {})

    def write(self, rows: DataFrame) -> str:
        """rows in a data folder of their own; its name goes into an entry."""
        name = uuid.uuid4().hex
        rows.write.parquet(str(self._path("data", name)))
        return name

    def read(self, *names: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[str(self._path("data", n)) for n in names])

    def commit(self, number: int, entry: dict) -> None:
        """Makes version `number`; raises Taken if it exists."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        new, place = self._path("entries", f".{uuid.uuid4().hex}"), self._path("entries", f"{number:012d}.json")
        out = fs.create(new, False)
        out.write(json.dumps(entry).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), fs.makeQualified(place), options)
        except Exception as e:
            fs.delete(new, False)
            if number in self.numbers():
                raise Taken(f"version {number} of {self.root} exists") from e
            raise

    def prune(self, keep: int = 1) -> int:
        """Removes all but the newest `keep` entries and the data that no entry left names; gives the number of data folders
        removed. Not for use while another writer is at work: its data have no entry yet."""
        fs, found = self._fs(), self.numbers()
        for n in found[:-keep] if keep else found:
            fs.delete(self._path("entries", f"{n:012d}.json"), False)
        held = set(_names([self.entry(n) for n in self.numbers()]))
        data = self._path("data")
        gone = [x.getPath() for x in fs.listStatus(data) if x.getPath().getName() not in held] if fs.exists(data) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _names(x) -> list[str]:
    """All strings in an entry: data folders are among them."""
    if isinstance(x, str):
        return [x]
    return [n for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else []) for n in _names(v)]

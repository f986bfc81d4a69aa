"""Several tables of plain files that change together: a numbered ledger entry names the files that count.

Files have no transactions.  A step writes new folders that nobody reads yet, and then one small entry that names the
folders of every table.  The entry appears under its number by a rename, so readers see all of a step or nothing of it; a
step that dies leaves folders that no entry names.  An entry also says which batch of which stream was the last, so a
replayed batch is known from the one newest entry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Ledger:
    """The entries of a folder; ``keep`` of them stay for readers that began earlier."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 20):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._base = self._path("_ledger")
        self._fs = self._base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._base):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._base)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def newest(self) -> tuple[int, dict]:
        """(number, content) of the newest entry; (-1, {}) where there is none."""
        numbers = self._numbers()
        if not numbers:
            return -1, {}
        stream = self._fs.open(self._path(f"_ledger/{numbers[-1]:012d}.json"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, number: int, content: dict) -> None:
        """Make ``content`` the entry of this number; an entry that is there already is never written over."""
        final, part = self._path(f"_ledger/{number:012d}.json"), self._path(f"_ledger/.{uuid.uuid4().hex}")
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            raise RuntimeError(f"entry {number} of {self.folder} was written by another")
        for old in self._numbers()[: -self.keep]:
            self._fs.delete(self._path(f"_ledger/{old:012d}.json"), False)

    def new_folder(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options: str) -> str:
        """Write rows to a folder of their own, which counts once an entry names it; ``options`` are the writer's."""
        path = self.new_folder(name)
        df.write.options(**options).parquet(path)
        return path

    def read(self, paths: list[str], schema: T.StructType | str) -> DataFrame:
        """Rows of the named folders together; none for no folder."""
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def batch_mark(df: DataFrame, batch_id: int) -> tuple[str, int]:
    """(stream, batch) that a micro-batch belongs to."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "", batch_id


def is_replay(content: dict, mark: tuple[str, int]) -> bool:
    """Whether the entry holds this batch of the stream, or a later one, already."""
    return content.get("done", {}).get(mark[0], -1) >= mark[1]


def with_mark(content: dict, mark: tuple[str, int] | None) -> dict:
    return content if mark is None else content | {"done": content.get("done", {}) | {mark[0]: mark[1]}}

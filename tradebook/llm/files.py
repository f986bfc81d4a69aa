"""Files in the folder all executors share, written and read inside tasks through Arrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder named by URI or by plain path."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class NewFile:
    """A file that appears under its name only when it is complete.

    A task that dies leaves a file of another name; the attempt that follows
    writes its own and moves it into place, so the file is always whole.
    """

    def __init__(self, folder: str, name: str):
        self.system, root = opened(folder)
        self.system.create_dir(root, recursive=True)
        self.path, self._part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self._out = self.system.open_output_stream(self._part, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.at += len(data)

    def done(self) -> None:
        self._out.close()
        self.system.move(self._part, self.path)


def read_blocks(folder: str, name: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file from start to end, a block at a time."""
    system, root = opened(folder)
    with system.open_input_stream(f"{root}/{name}", compression=None) as f:
        while block := f.read(size):
            yield block


def one_file_per_task(files: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` (batches of Arrow to batches of Arrow) over a table of files, every file in a task of its own.

    ``files`` needs a column ``file_no`` that counts from 0 without gaps; its rows are as few as the files.
    """
    n = max(1, files.count())
    return files.repartitionById(n, F.col("file_no")).mapInArrow(work, schema)

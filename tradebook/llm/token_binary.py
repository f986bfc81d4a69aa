"""Token ids of whole texts in binary files: blocks of the adaptive range coder, an index of documents, checksums.

A file holds a run of documents in ascending order of their ids:

    "TBK1"
    blocks                 (id_coder.encode: up to 8192 ids each, each with two checksums and a model of its own)
    index of documents     deflated: ids, flags of null ids, numbers of tokens
    footer                 <QQQQII: place and length of the index, documents, tokens, crc of the index, "1KBT"

A document may span blocks and share blocks with its neighbours.  The table is range-partitioned by id, a file per
partition, so the files in order of their numbers hold the documents in order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm import id_coder, tokenise
from tradebook.llm.common import crc, stored
from tradebook.llm.files import NewFile, one_file_per_task, opened
from tradebook.session import scratch_folder

MAGIC = b"TBK1"
_FOOT = struct.Struct("<QQQQII")
_FOOT_MARK = int.from_bytes(b"1KBT", "little")
FILE_CHARS = 20_000_000  # bytes of text that a file holds, about: one group of blocks
_GROUP = id_coder.LANES * id_coder.BLOCK
FOUND = "part int, name string, documents long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


class Writer:
    """Appends documents to a file; holds one group of blocks at most, whatever the length of a text."""

    def __init__(self, folder: str, name: str):
        self.file = NewFile(folder, name)
        self.file.write(MAGIC)
        self._parts: list[bytes] = []
        self._held = self.tokens = 0
        self._docs: list[int | None] = []
        self._sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id)
        self._sizes.append(len(ids) // 4)
        self._parts.append(ids)
        self._held += len(ids) // 4
        while self._held >= _GROUP:
            self._flush(_GROUP)

    def _flush(self, n: int) -> None:
        every = b"".join(self._parts)
        for b in id_coder.encode(np.frombuffer(every, "<u4", n)):
            self.file.write(b)
        self.tokens += n
        self._parts, self._held = [every[4 * n :]], self._held - n

    def done(self) -> None:
        if self._held:
            self._flush(self._held)
        index = zlib.compress(
            np.array([d or 0 for d in self._docs], "<i8").tobytes()
            + bytes(d is None for d in self._docs)
            + np.array(self._sizes, "<i8").tobytes()
        )
        at = self.file.at
        self.file.write(index + _FOOT.pack(at, len(index), len(self._docs), self.tokens, crc(index), _FOOT_MARK))
        self.file.done()


def read_file(folder: str, name: str) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, place of its first token in the file, n_tokens, crc32 of its ids) of the documents of a file."""
    system, root = opened(folder)
    with system.open_input_file(f"{root}/{name}") as f:
        size = f.size()
        f.seek(size - _FOOT.size)
        at, length, documents, tokens, check, mark = _FOOT.unpack(f.read(_FOOT.size))
        f.seek(at)
        index = f.read(length)
        if mark != _FOOT_MARK or crc(index) != check:
            raise ValueError(f"{name}: the index is damaged")
        raw = zlib.decompress(index)
        ids, null = np.frombuffer(raw, "<i8", documents), np.frombuffer(raw, np.uint8, documents, 8 * documents)
        sizes = np.frombuffer(raw, "<i8", documents, 9 * documents)
        f.seek(0)
        if f.read(4) != MAGIC or int(sizes.sum()) != tokens:
            raise ValueError(f"{name}: not a file of token ids")
        doc, left, place, so_far = 0, int(sizes[0]) if documents else 0, 0, 0
        start = 0
        while f.tell() < at:
            blocks = []
            while f.tell() < at and len(blocks) < id_coder.LANES:
                head = f.read(id_coder.HEAD_SIZE)
                blocks.append(head + f.read(id_coder.block_size(head) - id_coder.HEAD_SIZE))
            data = id_coder.decode(blocks).tobytes()
            used = 0
            while doc < documents and 4 * left <= len(data) - used:
                so_far = crc(data[used : used + 4 * left], so_far)
                used += 4 * left
                yield None if null[doc] else int(ids[doc]), start, int(sizes[doc]), so_far
                start += int(sizes[doc])
                doc, so_far = doc + 1, 0
                left = int(sizes[doc]) if doc < documents else 0
            if doc < documents:
                so_far = crc(data[used:], so_far)
                left -= (len(data) - used) // 4
            place += len(data) // 4
        if doc != documents or place != tokens:
            raise ValueError(f"{name}: the blocks end early")


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_chars: int = FILE_CHARS
) -> DataFrame:
    """Write the files; (part, name, documents, tokens) of each."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    chars = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-chars // file_chars))
    end = struct.pack("<I", end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, out = f"part-{part:06d}.tbk", None
        words = tokenise.words(vocabulary)
        for b in batches:
            out = out or Writer(folder, name)
            for at in range(0, b.num_rows, 500):
                some = b.slice(at, 500)
                for d, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                    out.add(d, ids + end)
        if out:
            out.done()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "name": [name], "documents": pa.array([len(out._docs)], pa.int64()), "tokens": pa.array([out.tokens], pa.int64())}
            )

    placed = narrow.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(placed.mapInArrow(work, FOUND), "token-files")


def read(spark: SparkSession, found: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, decoded from the files."""
    files, before = [], 0
    for r in sorted(found.collect(), key=lambda r: r["part"]):  # a row per file
        files.append((len(files), r["name"], before))
        before += r["tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                rows = []
                for d, start, n, check in read_file(folder, row["name"]):
                    rows.append((d, row["before"] + start, n, check, row["name"]))
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    table = spark.createDataFrame(files, "file_no int, name string, before long")
    return one_file_per_task(table, work, ROWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    d, s, n, c, f = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(f, pa.string())],
        ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
    )


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, **names: str) -> DataFrame:
    """Encode and write all documents, then read the files: (doc_id, start, n_tokens, ids_crc32, file).

    ``start`` counts the ids of all documents before, end ids included.  Null and empty texts are the end id alone.
    Null ids stand first; rows that repeat an id stand in the order of their texts, one row each.  An empty table makes
    no file and no row.  Every block's checksums are tested on the way.
    """
    folder = scratch_folder(spark, "token-ids")
    found = write(docs, folder, vocabulary or tokenise.word_bpe_path(), end_id, **names)
    return read(spark, found, folder)

"""WARC archives from pages; archives compressed as one stream rewritten record by record, with an offset index.

``write_archives`` makes the common bad case: a WARC file compressed as one gzip
member, in which no record can be reached without inflating all before it.
``normalise`` inflates each such file once, as a stream, writes every record as
a member of its own, and beside the file an index with the offset and length of
each member.  ``read_records`` reaches the records through that index.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import stored
from tradebook.llm.files import NewFile, one_file_per_task, opened, read_blocks
from tradebook.session import scratch_folder

LEAST_REVISIT = 100  # bytes: shorter payloads are always written out
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # fixed, so that a rerun writes the same bytes
FILES = "file_no int, name string, records long"


# --- which pages repeat ------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to).

    ``refers_to`` is the smallest id among the pages of equal payload, null for that page itself and for payloads
    under ``LEAST_REVISIT`` bytes.  A payload shared by any number of pages is one row of a pre-aggregated table, which
    is written before the join: both sides of the join are then plain, so Spark can split a payload that holds many rows.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")
    ).select(
        "page_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    shared = stored(
        rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        .select("payload_digest", "_first"),
        "warc-shared",
    )
    return rows.join(shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("_first") != F.col("page_id"), F.col("_first")).alias("refers_to"),
    )


# --- records -----------------------------------------------------------------------------------------


def _record(row: dict) -> bytes:
    page = "null" if row["page_id"] is None else str(row["page_id"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + row["payload"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {DATE}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~", errors="replace"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")


class Records:
    """Cuts a stream of inflated bytes into whole records."""

    def __init__(self) -> None:
        self._have = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self._have += data
        at = 0
        while (end := self._have.find(b"\r\n\r\n", at)) >= 0:
            size = _LENGTH.search(self._have, at, end + 2)
            if size is None or not self._have.startswith(b"WARC/", at):
                raise ValueError("not a WARC record")
            stop = end + 4 + int(size[1]) + 4
            if len(self._have) < stop:
                break
            yield bytes(self._have[at:stop])
            at = stop
        del self._have[:at]

    def finish(self) -> None:
        if self._have:
            raise ValueError(f"the archive ends inside a record: {len(self._have)} bytes are left")


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, a piece at a time; a file that ends early is an error."""
    z, fresh = zlib.decompressobj(31), True
    for block in blocks:
        while block:
            data, fresh = z.decompress(block, 1 << 20), False
            if data:
                yield data
            if z.eof:
                block, z, fresh = z.unused_data, zlib.decompressobj(31), True
            else:
                block = z.unconsumed_tail
    if not fresh:
        yield z.flush()
        if not z.eof:
            raise ValueError("the gzip stream ends early")


def _fields(record: bytes) -> dict:
    """Id, type, reference, payload and digests of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = named["WARC-Type"]
    said = int(_LENGTH.search(http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {named['WARC-Record-ID']}: the payload doesn't match its header")
    page = lambda x: None if x is None or x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").rstrip(">"))
    return {
        "page_id": page(named["WARC-Record-ID"]), "payload_bytes": said, "payload_digest": digest, "record_type": kind,
        "refers_to": page(named.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


# --- files -------------------------------------------------------------------------------------------


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """One archive per partition, compressed as a single gzip member; (file_no, name, records) of the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, z = None, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for row in batch.to_pylist():
                out = out or NewFile(folder, name)
                out.write(z.compress(_record(row)))
                n += 1
        if out:
            out.write(z.flush())
            out.done()
            yield pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([n], pa.int64())})

    found = stored(rows.mapInArrow(work, "name string, records long"), "warc-files")
    return with_file_no(found)


def with_file_no(found: DataFrame) -> DataFrame:
    """A table of files numbered from 0; it has a row per file, so the driver may hold it."""
    names = sorted((r["name"], r["records"]) for r in found.collect())
    return found.sparkSession.createDataFrame([(i, n, r) for i, (n, r) in enumerate(names)], FILES)


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive of ``files`` from folder ``source`` to ``target``, a member per record.

    Beside ``x.warc.gz`` stands ``x.warc.gz.idx``: a JSON line per record with offset, length and record id.  One pass per
    file; what a task holds is one block of the file and one record.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, n = row["name"], 0
                out, index, cut = NewFile(target, name), NewFile(target, f"{name}.idx"), Records()

                def keep(record: bytes, out: NewFile = out, index: NewFile = index) -> None:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member, at = z.compress(record) + z.flush(), out.at
                    out.write(member)
                    page = re.search(rb"(?m)^WARC-Record-ID: (\S+)", record)[1].decode()
                    index.write(json.dumps({"offset": at, "length": len(member), "id": page}).encode() + b"\n")

                for data in inflated(read_blocks(source, name)):
                    for record in cut.feed(data):
                        keep(record)
                        n += 1
                cut.finish()
                out.done()
                index.done()
                yield pa.RecordBatch.from_pydict(
                    {"file_no": pa.array([row["file_no"]], pa.int32()), "name": [name], "records": pa.array([n], pa.int64())}
                )

    return stored(one_file_per_task(files, work, FILES), "warc-normal")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of normalised archives, each reached by the offset in the index and inflated alone."""
    schema = READ + (", payload binary" if with_payload else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_pydict(
            {c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns}
        )
        for batch in batches:
            for row in batch.to_pylist():
                system, root = opened(folder)
                rows, size = [], 0
                with system.open_input_file(f"{root}/{row['name']}") as f, system.open_input_stream(
                    f"{root}/{row['name']}.idx", compression=None
                ) as index:
                    for line in _lines(index):
                        at = json.loads(line)
                        f.seek(at["offset"])
                        record = zlib.decompress(f.read(at["length"]), 31)
                        rows.append(_fields(record))
                        size += len(record) if with_payload else 200
                        if size > 4 << 20:
                            yield give(rows)
                            rows, size = [], 0
                if rows:
                    yield give(rows)

    return one_file_per_task(files, work, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 18):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def archive(spark: SparkSession, pages: DataFrame, **names: str) -> DataFrame:
    """Pages to archives of one stream each, to normalised archives, and read back: one row per row of ``pages``.

    Null html is an empty payload, null url a record without target, null page_id a record without number.  Of rows that
    repeat an id and a payload none refers to another.  An empty table makes no file and no row.
    """
    raw, normal = scratch_folder(spark, "warc-raw"), scratch_folder(spark, "warc")
    files = write_archives(with_revisits(pages, **names), raw)
    return read_records(normalise(files, raw, normal), normal)

"""Near duplicates by SimHash fingerprints, linked through keys made by decoding segments with the Golay code.

A fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of
the [23, 12, 7] code.  Let two fingerprints differ in at most four bits, a <= b
<= c of them in the three segments.  Either b <= 1, so two segments differ in at
most one bit each; or a = 0, so one segment is equal.  For the first case a
fingerprint is filed under the nearest codewords of each pair of segments and
looked up under all codewords within four bits of them; for the second, filed and
looked up under each segment as it is.  So no link is missed; what meets under a
key is verified by counting bits inside the join.

Copies with equal fingerprints are one row before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm import golay
from tradebook.llm.common import as_bytes, stored
from tradebook.operators.dedupe import components

MOST_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash over the word shingles of the lower-cased text, repeats included; no words: 0."""
    words = as_bytes(text).lower().split()  # bytes: A-Z alone become small, and blanks are 20 and 09 to 0D alone
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if n >= width:
        starts, ends = starts[: n - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        work, "doc_id long, fp long"
    )


def filed_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 6): the keys under which fingerprints are filed.  Bits 46 and up of a key tell the kinds apart."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.nearest(s) for s in seg]
    out = [(k << 46) | (near[i] << 12) | near[j] for k, (i, j) in enumerate(PAIRS)]
    return np.stack(out + [((3 + k) << 46) | s for k, s in enumerate(seg)], axis=1)


def lookup_keys(fp: np.ndarray) -> np.ndarray:
    """(n, 111): the keys under which fingerprints are looked up, -1 where there are fewer."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.nearby(s) for s in seg]
    out = []
    for k, (i, j) in enumerate(PAIRS):
        a, b = near[i][:, :, None], near[j][:, None, :]
        out.append(np.where((a < 0) | (b < 0), -1, (k << 46) | (a << 12) | b).reshape(len(fp), 36))
    return np.concatenate(out + [((3 + k) << 46 | s)[:, None] for k, s in enumerate(seg)], axis=1)


def _keyed(fps: DataFrame, keys, name: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(every), 1000):
                fp = every[at : at + 1000]
                k = keys(fp)
                row, _ = np.nonzero(k >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(k[k >= 0]), pa.array(fp.view(np.int64)[row])], ["key", name])

    return fps.select("fp").mapInArrow(work, f"key long, {name} long")


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints that differ in at most ``most_bits`` (4 or fewer) bits.

    ``fps`` has every fingerprint once.  Both sides of the join are plain shuffles, so Spark splits a crowded key.  They
    are asked for by name: Spark sizes the keys by the rows they are made of, up to 111 times too low, and would send them
    to the driver.
    """
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the keys hold for {MOST_BITS} bits or fewer")
    filed, looked = _keyed(fps, filed_keys, "a"), _keyed(fps, lookup_keys, "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)
    return filed.join(looked.hint("merge"), "key").where(close).select("a", "b").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links.  Null and empty texts have fingerprint 0, which links like
    any other.  Rows with a null id take part and keep their null; if a group has no id at all its component is null.
    Repeated rows give repeated rows.
    """
    rows = stored(fingerprints(docs, doc_id, text), "golay-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "golay-classes")
    pairs = stored(links(classes, most_bits), "golay-links")
    groups = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "fp")
    placed = stored(classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "golay-placed")
    # groups are made of fingerprints: a fingerprint without any id ties its neighbours all the same
    least = stored(placed.groupBy("component").agg(F.min("rep").alias("component_id")), "golay-least")
    group_of = stored(placed.join(least, "component").select("fp", "component_id"), "golay-groups")
    return rows.join(group_of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


"""Benchmark passages in documents by the q-gram lemma, overlapping diagonal bands and banded alignment.

An item of ``m`` characters that stands in a document with at most ``e`` edits
shares at least ``m - q + 1 - q e`` of its q-grams with it, on diagonals that
spread over at most ``e``.  So: look up every q-gram of the document, count the
hits of each item in bands of diagonals, each band overlapping the next by half
and wider than ``e``, keep the bands that reach the bound, and align the item
with the text of the band.  No place within the budget is missed; the alignment
decides.

Texts are compared in small letters, every run of other characters than letters
and digits as one blank.  The items are held in blocks of bounded size; each
block is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import stored

Q = 12
BUDGET = 0.07  # edits per character of the item
BLOCK_CHARS = 4_000_000  # characters of items that a pass holds in each task, about
_TABLE_BITS = 22
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, Q // 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = 32


@lru_cache(1)
def _letters() -> np.ndarray:
    """Small letter of each character of the basic plane, blank for what is neither letter nor digit."""
    out = np.full(0x10000, _BLANK, np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def plain(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(characters, their places in the text) in the form that is compared."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    table = _letters()
    low = np.where(raw < 0x10000, table[np.minimum(raw, 0xFFFF)], raw) if (raw >= 0x10000).any() else table[raw]
    blank = low == _BLANK
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]  # the first of a run of blanks
    at = np.flatnonzero(keep)
    while len(at) and low[at[0]] == _BLANK:
        at = at[1:]
    if len(at) and low[at[-1]] == _BLANK:
        at = at[:-1]
    return low[at], at


def grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit number for each q-gram."""
    n = len(chars) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = chars.astype(np.uint64)
    three = wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42)  # a character has 21 bits
    out = three[:n] * _MULTIPLIERS[0]
    for k in range(1, Q // 3):
        out += three[3 * k : 3 * k + n] * _MULTIPLIERS[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def budget(m: int) -> int:
    """Edits an item of ``m`` characters may have; the lemma's bound stays at one q-gram or more."""
    return max(0, min(int(BUDGET * m), (m - Q) // Q))


@dataclass
class Index:
    """A block of items: their characters, and where each q-gram stands in which."""

    ids: list[int]
    chars: list[np.ndarray]
    keys: np.ndarray  # sorted q-grams
    first: np.ndarray  # where each begins in item and place
    item: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Index:
        ids, chars = [], []
        for i, t in items:
            c = plain(t)[0]
            if len(c) >= Q:
                ids.append(i)
                chars.append(c)
        g = [grams(c) for c in chars]
        every = np.concatenate(g) if g else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[keys >> np.uint64(64 - _TABLE_BITS)] = True
        edits = np.array([budget(len(c)) for c in chars], np.int64)
        sizes = np.array([len(c) for c in chars], np.int64)
        return cls(ids, chars, keys, np.append(first, len(every)), item[order], place[order], edits, sizes - Q + 1 - Q * edits, table)

    def bands(self, chars: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last) of the bands that reach the lemma's bound.

        A band is two steps of ``edits + 1`` wide; two neighbours that both reach it are given as one.
        """
        g = grams(chars)
        at = np.flatnonzero(self.table[g >> np.uint64(64 - _TABLE_BITS)]) if len(g) and len(self.keys) else np.zeros(0, np.int64)
        if not len(at):
            return []
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        real = self.keys[k] == g[at]
        at, k = at[real], k[real]
        found: dict[tuple[int, int], int] = {}
        # hits in pieces of bounded size: a q-gram may stand in many items and places
        times = self.first[k + 1] - self.first[k]
        ends = np.cumsum(times)
        cut = 0
        while cut < len(at):
            upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + 2_000_000)))
            t, kk, pp = times[cut:upto], k[cut:upto], at[cut:upto]
            hit = np.repeat(self.first[kk] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            item = self.item[hit]
            step = self.edits[item] + 1
            band = (np.repeat(pp, t) - self.place[hit]) // step + (1 << 30)
            key, n = np.unique((item << 32) | band, return_counts=True)
            for a, b in zip(key.tolist(), n.tolist(), strict=True):
                found[a] = found.get(a, 0) + b
            cut = upto
        good = set()  # by the step with which the band begins
        for key, n in found.items():
            least = self.least[key >> 32]
            if n + found.get(key + 1, 0) >= least:
                good.add(key)
            if n + found.get(key - 1, 0) >= least:
                good.add(key - 1)
        out, last = [], None
        for key in sorted(good):
            item, first = key >> 32, (key & 0xFFFFFFFF) - (1 << 30)
            width = int(self.edits[item]) + 1
            if last == key - 1:
                out[-1] = (item, out[-1][1], (first + 2) * width - 1)
                last = None
            else:
                out.append((item, first * width, (first + 2) * width - 1))
                last = key
        return out


_COST = 1 << 32


def align(item: np.ndarray, chars: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` in ``chars`` on the diagonals ``low`` .. ``high``.

    A cell holds edits and start in one number, so the least number is the least edits and then the earliest start.
    Beyond the text stands a character that equals none: to meet it costs as much as to leave the item's out.
    """
    n, m, width = len(chars), len(item), high - low + 1
    if (whole := _equal(item, chars[max(low, 0) : high + m])) >= 0:
        return 0, max(low, 0) + whole, max(low, 0) + whole + m
    text = np.full(m + width, 0xFFFFFFFF, np.uint32)
    a, b = max(low, 0), min(low + m + width, n)
    if a >= b:
        return None
    text[a - low : b - low] = chars[a:b]
    diagonals = np.arange(low, high + 1, dtype=np.int64)
    cells = np.where((diagonals >= 0) & (diagonals <= n), np.maximum(diagonals, 0), np.int64(1) << 60)
    ramp = np.arange(width, dtype=np.int64) * _COST
    for i in range(m):
        step = cells + _COST * (text[i : i + width] != item[i])
        np.minimum(step[:-1], cells[1:] + _COST, out=step[:-1])  # a character of the item is left out
        step -= ramp
        np.minimum.accumulate(step, out=step)  # characters of the text are put in
        step += ramp
        cells = step
    best = int(cells.argmin())
    value = int(cells[best])
    return value // _COST, value % _COST, min(low + best + m, n)


def _equal(item: np.ndarray, chars: np.ndarray) -> int:
    """Where ``chars`` holds ``item`` as it is, -1 if nowhere."""
    inside, wanted, at = chars.tobytes(), item.tobytes(), -1
    while (at := inside.find(wanted, at + 1)) >= 0:
        if at % item.itemsize == 0:
            return at // item.itemsize
    return -1


def find(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) of the items in a text, places in characters of the text as it is.

    Of overlapping places of an item the one with the fewest edits stays, of these the first.
    """
    chars, at = plain(text)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for item, low, high in index.bands(chars):
        e = int(index.edits[item])
        got = align(index.chars[item], chars, low - e, high + e)
        if got is not None and got[0] <= e and got[1] < got[2]:
            out.setdefault(item, []).append(got)
    rows = []
    for item, places in out.items():
        chosen: list[tuple[int, int, int]] = []
        for p in sorted(set(places)):
            if all(p[2] <= c[1] or p[1] >= c[2] for c in chosen):
                chosen.append(p)
        rows += [(index.ids[item], int(at[s]), int(at[e - 1]) + 1, d) for d, s, e in chosen]
    return sorted(rows)


MATCHES = "doc_id long, item_id long, start long, end long, edits int"


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[tuple[Index, bool]]:
    """(index of a block of items, whether more follow), block by block; the driver holds one block at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // block_chars)
    for k in range(n):
        found = Index.of(sorted((r["i"], r["t"] or "") for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()))
        yield found, k < n - 1
        del found


def _written(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """The rows of a pass, written before the next begins, so that one index is alive at a time."""
    out = stored(rows, "qgram-pass")
    shared.destroy()
    return out


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every place of a benchmark item in a document within the edit budget.

    The budget is ``BUDGET`` edits per character of the item, in the compared form.  Items under ``Q`` characters in that
    form have no q-gram and are not looked for; null and empty texts hold nothing.  Repeated documents give repeated rows,
    rows of an item id twice are two items.  Documents without a match give no row.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spark = docs.sparkSession

    def one_pass(index: Index, more: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)  # bounded by block_chars

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in find(t, shared.value)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        ["doc_id", "item_id", "start", "end", "edits"],
                    )

        found = narrow.mapInArrow(work, MATCHES)
        return _written(found, shared) if more else found

    passes = [one_pass(*i) for i in _blocks(benchmark, item_id, item_text, block_chars)]
    return reduce(DataFrame.unionByName, passes) if passes else spark.createDataFrame([], MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` with all their columns that hold no benchmark item; decided beside the row, without a join."""
    at, schema, spark = docs.columns.index(text), docs.schema, docs.sparkSession
    for index, more in _blocks(benchmark, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not find(t, shared.value) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, schema)
        if more:
            docs = _written(docs, shared)
    return docs

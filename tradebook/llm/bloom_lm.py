"""Language-model scores from a log-frequency Bloom filter.

The filter holds every n-gram of the training texts once for each level of its count: an n-gram seen c times has the keys
(n-gram, 1) ... (n-gram, q) with q = 1 + floor(log_base c).  A count is read back by probing level after level until one is
missing; it is the middle of its level.  A probe never misses what is there; one in about a hundred finds what is not.

Counting is one pass over the texts.  A task adds up the n-grams it meets, as hashes, and sends packed sorted pieces to
buckets, which are ranges of the hash: no bucket is hot, however often a word or a passage repeats.  Each bucket merges its
pieces and makes its own segment of the filter.  The filter grows with the corpus.  It is broadcast in parts of at most
``part_bytes``: with several parts the documents are read once for each, and the levels found so far stay beside them.

The probability of a word after its context is mixed over orders: ``(c(context word) + mu p(word | shorter context)) /
(c(context) + mu)``, an n-gram never counting more than its context; with the shortest, ``(c(word) + 1) / (N + V + 1)``.

The base score asks for exact counts.  Words at least as frequent as a threshold that some ``frequent_words`` words reach
are broadcast with their counts; the others that the filter holds are joined by a hash of 96 bits, so no join key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm.common import as_bytes, stored

ORDER, BASE, MU = 2, 2.0, 20.0
BITS_A_KEY, PROBES = 10, 6  # one chance hit in about a hundred
PART_BYTES = 128 << 20
BUCKET_BYTES = 16 << 20  # of text to a bucket, about
FREQUENT_WORDS = 1_000_000
START, END = b" ", b"\n"  # no word holds white space
_MOST_WORDS, _MOST_GRAMS, _AT_ONCE = 400_000, 4_000_000, 200
_BLOCK = 512  # bits of a block; all probes of a key fall in one
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Rows the model doesn't learn from: crc32 of the id as text leaves 2 when divided by 7; a row without id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of them."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a hash: ranges of equal width, so sorted hashes are sorted by bucket."""
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


class Vocabulary(dict):
    """Word to a number of its own; ``a`` (64 bits) and ``b`` (32 bits) name a word among all tasks."""

    def __init__(self):
        super().__init__()
        self._a, self._b = [], []
        self.a, self.b = np.zeros(0, _U), np.zeros(0, np.uint32)
        for w in (START, END):
            self[w]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self._a.append(h & 0xFFFFFFFFFFFFFFFF)
        self._b.append(h >> 64 & 0xFFFFFFFF)
        self[word] = at = len(self)
        return at

    def sequence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, each text with START before and END after, and the place of each text's START."""
        words, starts = [], []
        for t in texts:
            starts.append(len(words))
            words.append(START)
            words += as_bytes(t).lower().split()
            words.append(END)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.a) < len(self):
            self.a = np.concatenate([self.a, np.array(self._a, _U)])
            self.b = np.concatenate([self.b, np.array(self._b, np.uint32)])
            self._a, self._b = [], []
        return ids, np.array(starts, np.int64)


def _grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 ... order the hash of the n words that end at each place; before a START there are only STARTs."""
    n = len(words)
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    out = [words]
    for k in range(1, order):
        out.append(_mixed(out[-1] * _U(0x9E3779B97F4A7C15) + words[np.maximum(np.arange(n) - k, first)]))
    return out


def _added(h: np.ndarray, c: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted distinct hashes (with ``b``: pairs), their counts added up."""
    by = np.argsort(h, kind="stable") if b is None else np.lexsort((b, h))
    h, c, b = h[by], c[by], None if b is None else b[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if b is not None:
        new[1:] |= b[1:] != b[:-1]
    at = np.flatnonzero(new)
    return h[at], np.add.reduceat(c, at) if len(at) else c, None if b is None else b[at]


_PIECES = "bucket int, n int, h binary, c binary, b binary"


def _pieces(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """Packed sorted hashes and counts of the n-grams of a table (text), for each bucket and n."""

    def split(n: int, h: np.ndarray, c: np.ndarray, b: np.ndarray | None) -> list[tuple]:
        cuts = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
        held = np.flatnonzero(np.diff(cuts)).tolist()
        pack = lambda x, k: x[cuts[k] : cuts[k + 1]].tobytes()
        return [(k, n, pack(h, k), pack(c.astype("<i8"), k), None if b is None else pack(b, k)) for k in held]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "n", "h", "c", "b"])
        vocabulary, met, grams, size = Vocabulary(), [], [[] for _ in range(order)], 0

        def flushed() -> list[tuple]:
            rows = []
            counts = np.bincount(np.concatenate(met), minlength=len(vocabulary))
            some = np.flatnonzero(counts)
            rows += split(1, *_added(vocabulary.a[some], counts[some], vocabulary.b[some]))
            for n in range(2, order + 1):
                h = np.concatenate(grams[n - 1])
                rows += split(n, *_added(h, np.ones(len(h), np.int64)))
            return rows

        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):
                ids, starts = vocabulary.sequence(b.column(0).slice(at, _AT_ONCE).to_pylist())
                met.append(ids)
                found = _grams(vocabulary.a[ids], starts, order)
                for n in range(2, order + 1):
                    # a run of STARTs is a context only, so the longest is not counted
                    grams[n - 1].append(found[n - 1] if n < order else np.delete(found[n - 1], starts))
                size += len(ids)
                if size >= _MOST_GRAMS or len(vocabulary) >= _MOST_WORDS:
                    yield batch(flushed())
                    vocabulary, met, grams, size = Vocabulary(), [], [[] for _ in range(order)], 0
        if met:
            yield batch(flushed())

    return texts.mapInArrow(work, _PIECES)


# --- the filter ----------------------------------------------------------------------------------------


def level_of(counts: np.ndarray, base: float) -> np.ndarray:
    """1 + floor(log_base count)."""
    steps = base ** np.arange(1, 1 + int(np.ceil(np.log(2.0**63) / np.log(base))))
    return 1 + np.searchsorted(steps, counts, side="right")


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The middle of the counts of a level; nothing for level 0."""
    q = levels.astype(np.float64)
    return np.where(levels > 0, np.maximum((base ** (q - 1) + base**q - 1) / 2, base ** (q - 1)), 0.0)


def _bits(h: np.ndarray, level: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key (n-gram, level) among ``blocks`` blocks, and a number whose bits choose places in it."""
    key = _mixed(h + _U(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    return ((key >> _U(32)) * blocks.astype(_U) >> _U(32)).astype(np.int64), _mixed(key)


def _segment(grams: list[tuple[np.ndarray, np.ndarray]], base: float) -> bytes:
    """The bits of a bucket: every n-gram once for each level it reaches."""
    levels = [(h, level_of(c, base)) for h, c in grams]
    blocks = max(1, -(-sum(int(q.sum()) for _, q in levels) * BITS_A_KEY // _BLOCK))
    flags = np.zeros(blocks * _BLOCK, bool)
    for h, q in levels:
        for level in range(1, int(q.max(initial=0)) + 1):
            block, places = _bits(h[q >= level], level, np.int64(blocks))
            for p in range(PROBES):
                flags[block * _BLOCK + (places >> _U(9 * p) & _U(_BLOCK - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


class Part(NamedTuple):
    """Segments of consecutive buckets; ``start`` and ``blocks`` of a bucket count blocks, none for buckets of other parts."""

    bits: np.ndarray
    start: np.ndarray
    blocks: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """How many levels of each n-gram the part holds: probed one after the other, until one is missing."""
        out = np.zeros(len(h), np.uint8)
        bucket = _bucket(h, len(self.start))
        at = np.flatnonzero(self.blocks[bucket] > 0)
        start, blocks, left = self.start[bucket[at]], self.blocks[bucket[at]], h[at]
        level = 0
        while len(at):
            level += 1
            block, places = _bits(left, level, blocks)
            block, alive = (start + block) * _BLOCK, np.arange(len(at))
            for p in range(PROBES):
                bit = block[alive] + (places[alive] >> _U(9 * p) & _U(_BLOCK - 1)).astype(np.int64)
                alive = alive[self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1]
            at, start, blocks, left = at[alive], start[alive], blocks[alive], left[alive]
            out[at] = level
        return out


class Model(NamedTuple):
    """Tables in the shared folder, and the few numbers the driver holds."""

    segments: DataFrame  # bucket, bits
    words: DataFrame  # a, b, c: exact counts of words and END
    buckets: int
    tokens: int  # N
    kinds: int  # V
    order: int
    base: float

    def parts(self, most: int = PART_BYTES) -> Iterator[Part]:
        """The filter in parts of at most ``most`` bytes, or of one bucket; one at a time on the driver."""
        sizes = self.segments.select("bucket", F.length("bits").alias("n")).orderBy("bucket").toLocalIterator()
        groups, held = [], most
        for r in sizes:
            if held + r["n"] > most:
                groups.append([r["bucket"], r["bucket"]])
                held = 0
            groups[-1][1] = r["bucket"]
            held += r["n"]
        for lo, hi in groups:
            start, blocks = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64)
            bits, n = [], 0
            for r in self.segments.where(F.col("bucket").between(lo, hi)).toLocalIterator():
                piece = np.frombuffer(r["bits"], np.uint8)
                start[r["bucket"]], blocks[r["bucket"]] = n, len(piece) * 8 // _BLOCK
                n += len(piece) * 8 // _BLOCK
                bits.append(piece)
            yield Part(np.concatenate(bits), start, blocks)


def learned(texts: DataFrame, text: str = "text", order: int = ORDER, base: float = BASE, bucket_bytes: int = BUCKET_BYTES) -> Model:
    """Counts of all words and n-grams of whole texts.  Null and empty texts are END alone; no rows give an empty model."""
    rows = texts.select(F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size) // bucket_bytes + 1
    of_start = xxhash.xxh3_128_intdigest(START)
    start = _U(of_start & 0xFFFFFFFFFFFFFFFF), np.uint32(of_start >> 64 & 0xFFFFFFFF)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list] = {}
        bucket = None
        for b in batches:
            for k, n, h, c, w in zip(*(x.to_pylist() for x in b.columns), strict=True):
                bucket = k
                pieces.setdefault(n, []).append((np.frombuffer(h, _U), np.frombuffer(c, "<i8"), None if w is None else np.frombuffer(w, np.uint32)))
        if bucket is None:
            return
        grams, words = [], None
        for n in sorted(pieces):
            h, c, w = zip(*pieces.pop(n), strict=True)
            h, c, w = _added(np.concatenate(h), np.concatenate(c), np.concatenate(w) if n == 1 else None)
            grams.append((h, c))
            if n == 1:
                keep = ~((h == start[0]) & (w == start[1]))
                words = h[keep], w[keep], c[keep]
        bits = _segment(grams, base)
        empty = np.zeros(0, np.int64)
        a, w, c = words if words else (empty, empty, empty)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([bucket], pa.int32()), pa.array([bits], pa.binary()), pa.array([int(c.sum())], pa.int64()), pa.array([len(c)], pa.int64()),
                *[pa.array([x.astype(k).tolist()], pa.list_(t)) for x, k, t in ((a.view(np.int64), np.int64, pa.int64()), (w.astype(np.int64), np.int64, pa.int64()), (c, np.int64, pa.int64()))],
            ],
            ["bucket", "bits", "tokens", "kinds", "a", "b", "c"],
        )

    pieces = _pieces(rows, order, buckets).repartitionById(buckets, F.col("bucket"))
    made = stored(pieces.mapInArrow(merged, "bucket int, bits binary, tokens long, kinds long, a array<long>, b array<long>, c array<long>"), "lm-buckets")
    totals = made.agg(F.sum("tokens"), F.sum("kinds")).first()
    words = made.select(F.inline(F.arrays_zip("a", "b", "c")))
    return Model(made.select("bucket", "bits"), words, buckets, totals[0] or 0, totals[1] or 0, order, base)


def _frequent(words: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(threshold, a, b, c): all words with at least ``threshold`` occurrences, a power of two; at most ``most`` words."""
    by = {r["e"]: r["count"] for r in words.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).count().collect()}  # 63 rows at most
    e, held = 64, 0
    while e > 0 and held + by.get(e - 1, 0) <= most:
        e -= 1
        held += by.get(e, 0)
    threshold = 1 << e
    got = words.where(F.col("c") >= F.lit(threshold if e < 63 else (1 << 63) - 1)).toArrow().combine_chunks()
    a, b, c = (got.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "c"))
    by_a = np.lexsort((b, a.view(_U)))
    return threshold, a.view(_U)[by_a], b[by_a].astype(np.uint32), c[by_a]


def _exact(a: np.ndarray, b: np.ndarray, known: tuple) -> np.ndarray:
    """Counts of the words that the broadcast holds, -1 for others."""
    ka, kb, kc = known
    out = np.full(len(a), -1, np.int64)
    at, left = np.searchsorted(ka, a), np.arange(len(a))
    while len(left):  # words that share ``a`` lie beside each other
        left = left[at[left] < len(ka)]
        left = left[ka[at[left]] == a[left]]
        hit = kb[at[left]] == b[left]
        out[left[hit]] = kc[at[left[hit]]]
        left = left[~hit]
        at[left] += 1
    return out


_LEVELS = "doc_id long, held_out boolean, text string, levels binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_known double, score double, a array<long>, b array<long>, n array<long>"


class _Probed:
    """Levels of the n-grams of texts; those of a word are probed once for as long as the vocabulary lasts."""

    def __init__(self, part: Part, order: int):
        self.part, self.order, self.vocabulary, self._words = part, order, Vocabulary(), np.zeros(0, np.uint8)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, places of the STARTs, and a row of levels for each n."""
        ids, starts = self.vocabulary.sequence(texts)
        new = self.vocabulary.a[len(self._words) :]
        self._words = np.concatenate([self._words, self.part.levels(new)])
        grams = _grams(self.vocabulary.a[ids], starts, self.order)
        return ids, starts, np.vstack([self._words[ids], *(self.part.levels(h) for h in grams[1:])])


def _with_levels(rows: DataFrame, part: Part, order: int) -> DataFrame:
    """The levels that a part holds, added to those found so far."""
    shared = rows.sparkSession.sparkContext.broadcast(part)  # at most a part

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probed = _Probed(shared.value, order)
        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):
                s = b.slice(at, _AT_ONCE)
                ids, starts, found = probed.of(s.column(2).to_pylist())
                ends = np.append(starts, len(ids))
                levels = [found[:, i:j].tobytes() for i, j in zip(ends, ends[1:])]  # noqa: B905
                levels = [x if y is None else (np.frombuffer(x, np.uint8) + np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(levels, s.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), s.column(2), pa.array(levels, pa.binary())], ["doc_id", "held_out", "text", "levels"])
                if len(probed.vocabulary) >= _MOST_WORDS:
                    probed = _Probed(shared.value, order)

    out = stored(rows.mapInArrow(work, _LEVELS), "lm-levels")
    shared.unpersist()
    return out


def probabilities(levels: np.ndarray, starts: np.ndarray, tokens: int, kinds: int, base: float, mu: float) -> np.ndarray:
    """Probability of each token after its context, from the levels of the n-grams (a row for each n) that end at it."""
    counts = count_of(np.arange(256), base)[levels]
    p = (counts[0] + 1) / (tokens + kinds + 1)
    before = np.maximum(np.arange(levels.shape[1]) - 1, np.repeat(starts, np.diff(np.append(starts, levels.shape[1]))))
    for n in range(1, len(levels)):
        context = counts[n - 1][before]
        counts[n] = np.where(counts[n - 1] > 0, np.minimum(counts[n], context), 0.0)
        p = (counts[n] + mu * p) / (context + mu)
    return p


def _scored(rows: DataFrame, part: Part, model: Model, known: tuple, mu: float) -> DataFrame:
    """A row per document: scores from the filter, exact sums over frequent words, and the rarer words that the filter holds."""
    shared = rows.sparkSession.sparkContext.broadcast((part, known))
    order, base, tokens, kinds = model.order, model.base, model.tokens, model.kinds

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known = shared.value
        probed, exact = _Probed(part, order), np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, _AT_ONCE):
                s, vocabulary = b.slice(at, _AT_ONCE), probed.vocabulary
                ids, starts, levels = probed.of(s.column(2).to_pylist())
                if len(exact) < len(vocabulary):
                    exact = np.concatenate([exact, _exact(vocabulary.a[len(exact) :], vocabulary.b[len(exact) :], known)])
                ends = np.append(starts, len(ids))
                for x, y, other in zip(ends, ends[1:], s.column(3).to_pylist()):  # noqa: B905
                    if other is not None:
                        levels[:, x:y] += np.frombuffer(other, np.uint8).reshape(order, y - x)
                logs = np.log10(probabilities(levels, starts, tokens, kinds, base, mu))
                logs[starts] = 0
                c = exact[ids]
                c[starts] = -1
                rare = np.flatnonzero((c < 0) & (levels[0] > 0))
                rare = rare[~np.isin(rare, starts)]
                doc = np.searchsorted(starts, rare, side="right") - 1
                # a word once for each document, with its number
                key, n = np.unique(doc * len(vocabulary) + ids[rare], return_counts=True)
                doc, word = key // len(vocabulary), key % len(vocabulary)
                cuts = pa.array(np.searchsorted(doc, np.arange(s.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int64))) for v in (vocabulary.a[word].view(np.int64), vocabulary.b[word], n)]
                sums = [np.add.reduceat(v, starts) for v in (c >= 0, np.log10(np.maximum(c, 0) + 1), logs)]
                n_tokens = np.diff(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(n_tokens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), *lists],
                    [x.split()[0] for x in _SCORED.split(", ")],
                )
                if len(vocabulary) >= _MOST_WORDS:
                    probed, exact = _Probed(part, order), np.zeros(0, np.int64)

    out = stored(rows.mapInArrow(work, _SCORED), "lm-scores")
    shared.unpersist()
    return out


def score(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", mu: float = MU, part_bytes: int = PART_BYTES, frequent_words: int = FREQUENT_WORDS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the model's log10 probability of the whole text with its end, ``base_score`` that of exact counts with one
    added.  Null and empty texts are their end alone.  Repeated rows give repeated rows, a null id stays null; other columns
    are ignored.  With an empty model every token has the probability 1.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", F.lit(None).cast("binary").alias("levels"))
    threshold, *known = _frequent(model.words, frequent_words)
    nothing = Part(np.zeros(0, np.uint8), np.zeros(model.buckets, np.int64), np.zeros(model.buckets, np.int64))
    parts = model.parts(part_bytes)
    part = next(parts, nothing)
    for following in parts:
        rows, part = _with_levels(rows, part, model.order), following
    found = _scored(rows, part, model, tuple(known), mu)
    del part, known
    # a row is known by its place in the files just written
    found = found.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    asked = found.select("file", "row", F.inline(F.arrays_zip("a", "b", "n")))
    rest = asked.join(model.words.where(F.col("c") < threshold), ["a", "b"]).groupBy("file", "row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("log_more")
    )
    size = F.lit(float(np.log10(model.tokens + model.kinds + 1)))
    return found.join(rest, ["file", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_known") + F.coalesce("log_more", F.lit(0.0)) - F.col("n_tokens") * size).alias("base_score"), "score",
    )


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents scored by a model of those that are not held out."""
    model = learned(docs.where(~held_out(F.col(doc_id))), text)
    return score(docs, model, doc_id, text)

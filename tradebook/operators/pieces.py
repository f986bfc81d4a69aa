"""Bulk search for pieces of words: positional postings of letter triples.

Every run of three characters of a text is posted with its places (the end is padded, so the last characters begin triples
too).  A term stands in a text where the triples that cover it stand at the right distance.  A query first meets the texts
that hold the rarest triple of all its terms; the places of the others are looked up for these texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.operators.keys import perhaps_in
from tradebook.session import checkpointed, written

_BITS = 21  # of a character's code
_MAP = 134_217_689  # bits of the map of triples that queries ask for; too few cost work, never a hit


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)


def _triples(codes: np.ndarray) -> np.ndarray:
    """The triple that begins at each character as one number; nothing follows the last character."""
    padded = np.concatenate([codes, np.zeros(2, np.int64)])
    return padded[:-2] << (2 * _BITS) | padded[1:-1] << _BITS | padded[2:]


def _asked_map(asked: DataFrame) -> tuple[list[int], np.ndarray]:
    """The widths of asked triples and a map with a bit set for each of them, of one size whatever the queries."""
    bit = (F.col("gram") % _MAP * 4 + F.col("width")) % _MAP
    bits, widths = np.zeros(4096 * (_MAP // 32768 + 1), np.uint8), set()
    pieces = asked.select("width", bit.alias("bit")).groupBy("width", F.expr("bit div 32768").alias("piece"))
    for r in pieces.agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).toLocalIterator():
        widths.add(r["width"])
        bits[r["piece"] << 12 : (r["piece"] + 1) << 12] |= np.frombuffer(r["bits"], np.uint8)
    return sorted(widths), bits


def postings(index: DataFrame, keys: Sequence[str], text: str = "searchable_text", asked: DataFrame | None = None) -> DataFrame:
    """(gram, *keys, places): the places, from 0, of every triple of every text; null and empty texts have none.

    With ``asked`` (width, gram; as ``cover`` gives them) only triples that begin with one of these, and a few more by
    chance: what no query asks for is neither sorted nor sent from the tasks that read the texts.
    """
    wanted = None
    if asked is not None:
        widths, bits = _asked_map(asked)
        wanted = index.sparkSession.sparkContext.broadcast(bits)

    def heard(g: np.ndarray) -> np.ndarray:
        """Where the triples stand that some query asks for."""
        on = np.zeros(len(g), bool)
        for w in widths:
            at = (g >> ((3 - w) * _BITS)) % _MAP
            at = (at * 4 + w) % _MAP
            on |= wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return np.flatnonzero(on)

    rows = index.select(*keys, F.col(text).cast("string").alias("_text")).where("_text <> ''")
    schema = ", ".join([*(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes), "gram long, places array<int>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                s = b.slice(at, 100)
                grams, places, sizes, rows_of = [], [], [], []
                for row, t in enumerate(s.column(len(keys)).to_pylist()):
                    g = _triples(_codes(t))
                    by = np.argsort(g, kind="stable") if wanted is None else heard(g)
                    if wanted is not None:
                        by = by[np.argsort(g[by], kind="stable")]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(g[by]) != 0])[: len(by)])
                    grams.append(g[by][first])
                    places.append(by.astype(np.int32))
                    sizes.append(np.diff(np.append(first, len(by))))
                    rows_of.append(np.full(len(first), row))
                ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                of = pa.array(np.concatenate(rows_of))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)))
                yield pa.RecordBatch.from_arrays([*(s.column(k).take(of) for k in range(len(keys))), pa.array(np.concatenate(grams)), lists], [*keys, "gram", "places"])

    return rows.mapInArrow(work, schema)


def grams(index: DataFrame, keys: Sequence[str], text: str = "searchable_text", at_once: int = 500) -> DataFrame:
    """(gram, *keys): the distinct triples of every text without their places, in order of the triples for ``at_once`` texts at a time."""
    rows = index.select(*keys, F.col(text).cast("string").alias("_text")).where("_text <> ''")
    schema = ", ".join([*(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes), "gram long"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                s = b.slice(at, at_once)
                of_text = [np.unique(_triples(_codes(t))) for t in s.column(len(keys)).to_pylist()]
                every = np.concatenate(of_text)
                by = np.argsort(every, kind="stable")
                of = pa.array(np.repeat(np.arange(len(of_text)), [len(g) for g in of_text])[by])
                yield pa.RecordBatch.from_arrays([*(s.column(k).take(of) for k in range(len(keys))), pa.array(every[by])], [*keys, "gram"])

    return rows.mapInArrow(work, schema)


def cover(queries: DataFrame) -> DataFrame:
    """(query_id, term, terms, width, gram, offset, parts): the triples that cover each term of a query.

    A term of one or two characters is the beginning of a triple: ``width`` says how many characters of it count.
    """
    terms = F.array_distinct(F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != ""))
    rows = queries.select("query_id", terms.alias("_terms")).where(F.size("_terms") > 0)
    rows = rows.select("query_id", F.size("_terms").alias("terms"), F.explode("_terms").alias("term"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, terms int, term string, width int, gram long, offset int, parts int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, term in enumerate(b.column(2).to_pylist()):
                codes = _codes(term)
                n = len(codes)
                if n < 3:
                    out.append((row, n, int(codes[0]) if n == 1 else int(codes[0] << _BITS | codes[1]), 0, 1))
                    continue
                g = _triples(codes)
                offsets = [*range(0, n - 3, 3), n - 3]
                out += [(row, 3, int(g[o]), o, len(offsets)) for o in offsets]
            if out:
                of, *columns = zip(*out, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(pa.array(of)) for k in range(3)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    ["query_id", "terms", "term", "width", "gram", "offset", "parts"],
                )

    return rows.mapInArrow(work, schema)


def _by_width(posted: DataFrame, widths: list[int]) -> DataFrame:
    """Postings under the first ``width`` characters of their triples, for each width that some term has; made once for all of them."""
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.shiftright("gram", (3 - w) * _BITS).alias("gram")) for w in widths])
    rest = [c for c in posted.columns if c != "gram"]
    return posted.select(*rest, F.explode(each).alias("_g")).select("_g.width", "_g.gram", *rest)


def search_pieces(queries: DataFrame, posted: DataFrame, keys: Sequence[str], texts: DataFrame | None = None, text: str = "searchable_text") -> DataFrame:
    """(query_id, *keys) of the texts that hold every term of a query as a piece.

    ``queries`` has query_id and query; terms are parted by white space, their case does not count.  A query without terms
    finds nothing.  Without ``texts`` no text is read: all is told from the postings.  With them (*keys, ``text``; a row for
    each key) the postings need no places: a query's terms are looked for in the texts that it meets, and only these are moved.
    """
    wanted = checkpointed(cover(queries))
    widths = [r["width"] for r in wanted.select("width").distinct().collect()]  # 1, 2, 3
    if not widths:
        return queries.select("query_id").limit(0).join(posted.select(*keys).limit(0))
    # postings of the queries' triples only (best made so: ``postings`` with ``asked``); they are read three times and never
    # kept, for with their places they outgrow the texts
    asked_for = written(wanted.select("width", "gram").distinct(), "pieces-grams")
    by = _by_width(posted, sorted(widths)).join(asked_for, ["width", "gram"], "left_semi")
    often = by.groupBy("width", "gram").agg(F.count("*").alias("df"))
    # a triple that no text has is the rarest of all: its query meets nothing
    rarest = wanted.join(often, ["width", "gram"], "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "width", "gram")).alias("_r")
    )
    rarest = written(rarest.where("_r.df > 0").select("query_id", "_r.width", "_r.gram"), "pieces-rarest")
    met = written(by.select("width", "gram", *keys).join(rarest, ["width", "gram"]).select("query_id", *keys).distinct(), "pieces-met")
    if texts is not None:
        terms = wanted.groupBy("query_id").agg(F.collect_set("term").alias("_terms"))  # of one query
        read = perhaps_in(texts.select(*keys, F.col(text).cast("string").alias("_text")), met, keys)
        held = F.forall("_terms", lambda t: F.col("_text").contains(t))
        return met.join(terms, "query_id").join(read, [*keys]).where(held).select("query_id", *keys)
    of_met = met.join(wanted, "query_id")
    # a term of one triple is there or not: a short one begins many triples of a text, so their places are left out
    alone, several = of_met.where("parts = 1"), of_met.where("parts > 1")
    there = perhaps_in(by.select("width", "gram", *keys), alone, ["width", "gram", *keys]).distinct()
    # what the texts hold is shuffled: Spark sizes it by rows that are not exploded yet and would send it to the driver
    short = alone.join(there.hint("merge"), ["width", "gram", *keys]).select("query_id", *keys, "term", "terms")
    asked = several.join(perhaps_in(by, several, ["width", "gram", *keys]).hint("merge"), ["width", "gram", *keys])
    placed = asked.withColumn("starts", F.expr("transform(places, p -> p - offset)"))
    # a term's parts agree on a start; there are as many lists as parts, each no longer than the text
    heard = placed.groupBy("query_id", *keys, "term").agg(
        F.first("terms").alias("terms"), F.first("parts").alias("parts"), F.collect_list("starts").alias("lists")
    )
    whole = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    long = heard.where((F.size("lists") == F.col("parts")) & (F.size(whole) > 0)).select("query_id", *keys, "term", "terms")
    found = long.unionByName(short.dropDuplicates(["query_id", *keys, "term"]))
    return found.groupBy("query_id", *keys).agg(F.count("*").alias("_n"), F.first("terms").alias("terms")).where("_n = terms").select("query_id", *keys)

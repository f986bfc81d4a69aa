"""Large CSV and JSON array files, read in pieces at once although a record may span lines.

Spark cuts a text file at any line end (CSV) or closing brace (JSON).  Whether a cut lies inside a quoted cell or a nested
object depends on all that stands before it, so a file is read in three steps:

1. every piece tells by how much it changes the state (inside quotes, depth of braces), for either state it may begin in;
2. the pieces' changes are summed in order of the file, a few numbers a piece;
3. every piece, now knowing its state, gives its whole records, and the parts at its ends are joined with their neighbours'.

Only the parts at the ends of pieces are shuffled, two a piece at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.sources.readers import CORRUPT, typed_cell

State = tuple[int, int]  # inside quotes; depth of braces
HEAD, WHOLE, TAIL = 1, 2, 3


@dataclass(frozen=True)
class Format:
    """``separator`` cuts a file into parts; ``scan`` tells the state after each part: a record ends where both numbers are zero."""

    separator: str
    scan: Callable[[pa.Array, State], tuple[np.ndarray, np.ndarray]]


def _counts(texts: pa.Array, mark: str) -> np.ndarray:
    return np.asarray(pc.count_substring(texts, mark)).astype(np.int64)


def _csv_scan(texts: pa.Array, state: State) -> tuple[np.ndarray, np.ndarray]:
    quoted = (state[0] + np.cumsum(_counts(texts, '"'))) % 2
    return quoted, np.zeros_like(quoted)


def _json_scan(texts: pa.Array, state: State) -> tuple[np.ndarray, np.ndarray]:
    bare = pc.replace_substring_regex(texts, r"(?s)\\.", "")
    quoted = (state[0] + np.cumsum(_counts(bare, '"'))) % 2
    before = np.concatenate([[state[0]], quoted[:-1]])
    opened = pc.binary_join_element_wise(pa.array(np.where(before, '"', "")), bare.cast(pa.string()), "")
    outside = pc.replace_substring_regex(opened, r'"[^"]*(?:"|\z)', "")
    return quoted, state[1] + np.cumsum(_counts(outside, "{") - (quoted == 0))


CSV, JSON = Format("\n", _csv_scan), Format("}", _json_scan)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """(piece, parts) in order; the parts of a piece may come in several runs."""
    for b in batches:
        if b.num_rows:
            start = b.column("start").to_numpy(zero_copy_only=False)
            names = b.column("file").to_pylist()
            cuts = [0, *(i for i in range(1, b.num_rows) if start[i] != start[i - 1] or names[i] != names[i - 1]), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):  # noqa: B905
                yield (names[a], int(start[a])), b.column("text").slice(a, z - a)


def _states(parts: DataFrame, form: Format) -> dict[tuple[str, int], State]:
    """The state in which each piece begins; a piece is some 128 MB of a file, so there are few of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = None, [(0, 0), (1, 0)]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [now[0]], "start": [now[1]], "flips": [ends[0][0]], "plain": [ends[0][1]], "quoted": [ends[1][1]]})

        for piece, texts in _runs(batches):
            if piece != now:
                if now is not None:
                    yield told()
                now, ends = piece, [(0, 0), (1, 0)]
            ends = [tuple(int(x[-1]) for x in form.scan(texts, s)) for s in ends]
        if now is not None:
            yield told()

    pieces = parts.mapInArrow(work, "file string, start long, flips long, plain long, quoted long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("quoted"))
    pieces = pieces.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    return {(r["file"], r["start"]): (r["inside"], r["depth"]) for r in pieces.select("file", "start", "inside", "depth").toLocalIterator()}


def records(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """(file, first, text, ended): the records of the files under ``path``; ``first`` marks the first one of a file.

    What stands after the last end of a record is one that is not ``ended``.
    """
    parts = spark.read.option("lineSep", form.separator).text(path)
    parts = parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    states = spark.sparkContext.broadcast(_states(parts, form))  # two numbers a piece
    names = ["file", "start", "place", "ended", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state, place = None, [], (0, 0), HEAD

        def batch(places: list[int], ended: bool, texts: list[str]) -> pa.RecordBatch:
            n = len(texts)
            columns = [pa.array([now[0]] * n), pa.array([now[1]] * n, pa.int64()), pa.array(places, pa.int32()), pa.array([ended] * n), pa.array(texts, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names)

        for piece, texts in _runs(batches):
            if piece != now:
                if held:
                    yield batch([TAIL], False, [form.separator.join(held)])
                if piece not in states.value:
                    raise ValueError(f"{piece} was cut otherwise before: spark.sql.files.maxPartitionBytes or the files have changed")
                now, held, state, place = piece, [], states.value[piece], HEAD
            quoted, depth = form.scan(texts, state)
            state, values, a, out = (int(quoted[-1]), int(depth[-1])), texts.to_pylist(), 0, []
            for e in np.flatnonzero((quoted == 0) & (depth == 0)).tolist():
                out.append(form.separator.join(held + values[a : e + 1]))
                held, a = [], e + 1
            held += values[a:]
            if out:
                yield batch([place] + [WHOLE] * (len(out) - 1), True, out)
                place = WHOLE
        if held:
            yield batch([TAIL], False, [form.separator.join(held)])

    found = parts.mapInArrow(work, "file string, start long, place int, ended boolean, text string")
    whole = found.where(F.col("place") == WHOLE).select("file", F.lit(False).alias("first"), "text", "ended")
    ends = F.coalesce(F.sum(F.col("ended").cast("long")).over(Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = found.where(F.col("place") != WHOLE).withColumn("nth", ends).groupBy("file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("of"), F.max("ended").alias("ended")
    )
    text = F.array_join(F.transform("of", lambda x: x["text"]), form.separator)
    return whole.unionByName(joined.select("file", (F.col("nth") == 0).alias("first"), text.alias("text"), "ended"))


def read_large_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) as ``readers.read_csv`` gives them, of files that are read in pieces.

    The first record of a file is its header; cells may hold line ends, and a line end is LF or CR LF.
    """
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": CORRUPT, "ignoreLeadingWhiteSpace": "true", "multiLine": "true"}
    lines = records(spark, path, CSV).where(~F.col("first")).select(F.rtrim("text", F.lit("\r")).alias("text")).where(F.trim("text") != "")
    raw = lines.select(F.from_csv("text", text.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r")).select("r.*")
    filled = F.coalesce(*[F.col(f.name) for f in schema.fields]).isNotNull()
    good = raw.where(F.col(CORRUPT).isNull() & filled)
    return good.select(*[typed_cell(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields]), raw.where(F.col(CORRUPT).isNotNull())


def read_large_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The objects of JSON array files (or of JSON lines) that are read in pieces.

    A file that breaks off inside an object is read as if a brace stood there.
    """
    found = records(spark, path, JSON).where("ended").select(F.concat(F.expr("substring(text, greatest(instr(text, '{'), 1))"), F.lit("}")).alias("text"))
    return found.select(F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")

"""A search table kept by segments: a write adds a segment, nothing that is there is rewritten.

A segment holds the index rows of a write, marks of the rows it takes away, and the triples of its texts.  Every task writes
the triples of its own texts, in order by blocks of texts, so they are never moved; places are not kept, for they outgrow the
texts many times: a search looks for its terms in the stored texts that the rarest triple leaves.  A row counts if no later segment has its id.  When several
segments of about one size have gathered they are merged, so there are never more than a few of each size, and a row is
rewritten once for each size it grows through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.operators.pieces import grams, search_pieces
from tradebook.operators.search import index_rows
from tradebook.sources.ledger import Ledger, batch_mark, is_replay, with_mark
from tradebook.streaming.streams import Batch

FANOUT = 4  # so many segments of a size become one, and a size is so many times the one below


def _size_class(rows: int) -> int:
    return int(math.log(max(rows, 1), FANOUT))


def _row_schema(content: dict) -> T.StructType:
    return T.StructType.fromJson(content["schema"])


def _rows(ledger: Ledger, content: dict, segments: list[dict]) -> DataFrame | None:
    """Rows and marks of segments with the number of their segment."""
    out = None
    for s in segments:
        df = ledger.read([s["rows_at"]], _row_schema(content)).withColumn("_seq", F.lit(s["seq"]).cast("long"))
        out = df if out is None else out.unionByName(df)
    return out


def _postings(ledger: Ledger, content: dict, segments: list[dict]) -> DataFrame | None:
    schema = T.StructType([_row_schema(content)["id"], T.StructField("gram", T.LongType())])
    out = None
    for s in segments:
        df = ledger.read([s["postings_at"]], schema).withColumn("_seq", F.lit(s["seq"]).cast("long"))
        out = df if out is None else out.unionByName(df)
    return out


def _newest(rows: DataFrame) -> DataFrame:
    """(id, _seq, _gone) of the last word on every id; narrow, the rows themselves stay where they are."""
    return rows.groupBy("id").agg(F.max(F.struct("_seq", "_gone")).alias("_m")).select("id", "_m._seq", "_m._gone")


def _segment(ledger: Ledger, rows: DataFrame, seq: int) -> dict:
    """Write a segment; ``rows`` has the index columns and ``_gone``."""
    rows_at = ledger.write(rows, "rows")
    back = ledger.spark.read.schema(rows.schema).parquet(rows_at)
    posted = grams(back.where("not _gone"), ["id"])
    return {"seq": seq, "rows": back.count(), "rows_at": rows_at, "postings_at": ledger.write(posted, "postings", compression="zstd")}


def _merged(ledger: Ledger, content: dict, seq: int) -> list[dict]:
    """Segments after merging those of a size that have become too many, smaller sizes first."""
    segments = content["segments"]
    while True:
        by_class: dict[int, list[dict]] = {}
        for s in segments:
            by_class.setdefault(_size_class(s["rows"]), []).append(s)
        many = [c for c, members in sorted(by_class.items()) if len(members) >= FANOUT]
        if not many:
            return segments
        # the run from the first to the last of them, so that no segment in between is passed over
        of = {s["seq"] for s in by_class[many[0]]}
        run = [s for s in segments if min(of) <= s["seq"] <= max(of)]
        rows = _rows(ledger, content, run)
        kept = rows.join(_newest(rows).drop("_gone"), ["id", "_seq"], "left_semi").drop("_seq")
        if run[0]["seq"] == segments[0]["seq"]:
            kept = kept.where("not _gone")  # nothing older is left to take away
        one = _segment(ledger, kept, run[-1]["seq"])
        segments = [s for s in segments if s["seq"] < run[0]["seq"]] + [one] + [s for s in segments if s["seq"] > run[-1]["seq"]]


def add_segment(spark: SparkSession, folder: str, rows: DataFrame | None, gone: DataFrame | None = None, mark: tuple[str, int] | None = None) -> None:
    """Index rows that a write made or changed, and ids that it took away; a replayed batch changes nothing.

    Of several rows of an id in one write that of the latest ``last_updated`` counts, then the one with the greatest text.
    """
    ledger = Ledger(spark, folder)
    number, content = ledger.newest()
    if mark and is_replay(content, mark):
        return
    new = None
    if rows is not None:
        payload = [c for c in rows.columns if c != "id"]
        best = F.max(F.struct("last_updated", "searchable_text", *[c for c in payload if c not in ("last_updated", "searchable_text")])).alias("_b")
        new = rows.groupBy("id").agg(best).select("id", *[F.col(f"_b.{c}").alias(c) for c in payload], F.lit(False).alias("_gone"))
    if gone is not None:
        ids = gone.select("id").distinct()
        if new is not None:
            ids = ids.join(new, "id", "left_anti")  # what the same write brings back stays
        schema = new.schema if new is not None else _row_schema(content)
        blank = ids.select(*[F.col("id") if f.name == "id" else F.lit(True).alias("_gone") if f.name == "_gone" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        new = blank if new is None else new.unionByName(blank)
    if "schema" not in content:
        content = content | {"schema": T.StructType([T.StructField(f.name, f.dataType) for f in new.schema]).jsonValue(), "segments": []}
    made = _segment(ledger, new.select(*_row_schema(content).names), number + 1)
    content = content | {"segments": [*content["segments"], made]}
    content["segments"] = _merged(ledger, content, number + 1)
    ledger.commit(number + 1, with_mark(content, mark))


def live_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The search table: the newest row of every id that was not taken away."""
    ledger = Ledger(spark, folder)
    _, content = ledger.newest()
    rows = _rows(ledger, content, content["segments"])
    live = _newest(rows).where("not _gone").drop("_gone")
    return rows.join(live, ["id", "_seq"], "left_semi").drop("_seq", "_gone")


def search_segments(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    """(query_id, id) of all rows that hold every term of a query as a piece, over all segments at once."""
    ledger = Ledger(spark, folder)
    _, content = ledger.newest()
    rows = _rows(ledger, content, content["segments"])
    live = _newest(rows).where("not _gone").drop("_gone")
    hits = search_pieces(queries, _postings(ledger, content, content["segments"]), ["id", "_seq"], rows.where("not _gone"))
    return hits.join(live, ["id", "_seq"], "left_semi").select("query_id", "id")


def index_stream(folder: str, as_of: Column, gone: Column | None = None) -> Batch:
    """Micro-batch step: index rows of the companies a batch wrote; ``gone`` says which of them were deleted."""

    def batch(df: DataFrame, batch_id: int) -> None:
        went = None if gone is None else df.where(gone)
        stay = df if gone is None else df.where(~F.coalesce(gone, F.lit(False)))
        add_segment(df.sparkSession, folder, index_rows(stay, as_of), went, batch_mark(df, batch_id))

    return batch

"""A table in hash buckets that a stream keeps: a batch rewrites the buckets it touches, all others stay as they are.

``discovery_step`` finds companies on the pages of a batch while the crawl goes on.  Three tables change together by one
ledger entry: companies by id, the keys they are matched by (website, source, name) by key, and evidence rows, which are
only added.  A batch reads the key buckets of its own keys and the company buckets of the ids these name, never the whole
table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.operators import html
from tradebook.operators import tables as tb
from tradebook.operators.evidence import listed_evidence
from tradebook.plans.discovery import found_records, placed_records
from tradebook.sources.ledger import Ledger, batch_mark, is_replay, with_mark
from tradebook.streaming.streams import Batch

BUCKETS = 64
MOST_PIECES = 16  # folders of rows that are only added, before they become one
COMPANY = "id string, name_en string, name_ar string, website_url string, source_url string, first_seen_at timestamp, last_seen_at timestamp"
KEY = "kind string, key string, id string"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, keys: list[str], buckets: int) -> list[str]:
    """Buckets of some rows: at most as many numbers as there are buckets."""
    return [str(r[0]) for r in rows.select(bucket_of(keys, buckets)).distinct().collect()]


def read_buckets(ledger: Ledger, files: dict[str, str], schema: str, wanted: list[str] | None = None) -> DataFrame:
    return ledger.read([p for b, p in sorted(files.items()) if wanted is None or b in wanted], schema)


def write_buckets(
    ledger: Ledger, name: str, files: dict[str, str], schema: str, keys: list[str], buckets: int, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame] | None = None
) -> tuple[dict[str, str], int]:
    """(files, buckets written) after an upsert of ``changes``: the buckets that hold one of their keys are written anew."""
    hit = touched(changes, keys, buckets)
    if not hit:
        return files, 0
    old = read_buckets(ledger, files, schema, hit)
    names = T.StructType.fromDDL(schema).names
    new = (change or (lambda o, c: tb.upsert(o, c, keys)))(old, changes.select(*names)).select(*names)
    folder = f"{ledger.folder}/{name}-{uuid.uuid4().hex}"
    new.withColumn("_bucket", bucket_of(keys, buckets)).repartition(len(hit), "_bucket").write.partitionBy("_bucket").parquet(folder)
    return files | {b: f"{folder}/_bucket={b}" for b in hit}, len(hit)


def _added(ledger: Ledger, name: str, pieces: list[str], rows: DataFrame, schema: str) -> list[str]:
    """Folders of a table that only grows; many small ones become one."""
    pieces = [*pieces, ledger.write(rows.select(*T.StructType.fromDDL(schema).names), name)]
    return pieces if len(pieces) <= MOST_PIECES else [ledger.write(ledger.read(pieces, schema), name)]


EVIDENCE = "company_id string, field_name string, value string, source_url string, source_page_id long, extraction_method string, confidence double"


def _empty() -> dict:
    return {"companies": {}, "keys": {}, "evidence": [], "top": 100_000, "written": 0, "buckets": BUCKETS}


def _keys_of(companies: DataFrame) -> DataFrame:
    return tb.identity_rows(companies, ["id"]).select("kind", "key", "id").distinct()


def _with_companies(ledger: Ledger, content: dict, companies: DataFrame) -> dict:
    n = content["buckets"]
    files, written = write_buckets(ledger, "companies", content["companies"], COMPANY, ["id"], n, companies)
    keys = ledger.spark.read.schema(KEY).parquet(ledger.write(_keys_of(companies), "keys-of"))
    # a key may name several companies, so its rows are added to those that are there; all of a key lie in one bucket
    by = lambda old, new: old.unionByName(new).distinct()
    key_files, _ = write_buckets(ledger, "keys", content["keys"], KEY, ["kind", "key"], n, keys, by)
    top = companies.agg(F.max(F.col("id").try_cast("long"))).first()[0]
    return content | {"companies": files, "keys": key_files, "top": max(content["top"], top or 0), "written": written}


def load_companies(spark: SparkSession, folder: str, companies: DataFrame, buckets: int = BUCKETS) -> None:
    """Begin a kept table with rows that are stored elsewhere; ``COMPANY`` has their columns, missing ones are null."""
    ledger = Ledger(spark, folder)
    number, content = ledger.newest()
    names = T.StructType.fromDDL(COMPANY)
    rows = companies.select(*[(F.col(f.name) if f.name in companies.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names])
    ledger.commit(number + 1, _with_companies(ledger, content or _empty() | {"buckets": buckets}, rows))


def kept_companies(spark: SparkSession, folder: str) -> DataFrame:
    ledger = Ledger(spark, folder)
    return read_buckets(ledger, ledger.newest()[1].get("companies", {}), COMPANY)


def kept_evidence(spark: SparkSession, folder: str) -> DataFrame:
    ledger = Ledger(spark, folder)
    return ledger.read(ledger.newest()[1].get("evidence", []), EVIDENCE)


def candidates_of(ledger: Ledger, content: dict, records: DataFrame) -> DataFrame:
    """Stored companies that share a key with some record: all rows that matching could look at."""
    n = content["buckets"]
    asked = ledger.write(tb.identity_rows(records, ["_rid"]).select("kind", "key").distinct(), "asked")
    keys = ledger.spark.read.schema("kind string, key string").parquet(asked)
    held = read_buckets(ledger, content["keys"], KEY, touched(keys, ["kind", "key"], n))
    ids = ledger.spark.read.schema("id string").parquet(ledger.write(held.join(keys, ["kind", "key"], "left_semi").select("id").distinct(), "ids"))
    return read_buckets(ledger, content["companies"], COMPANY, touched(ids, ["id"], n)).join(ids, "id", "left_semi")


def discovery_step(folder: str, as_of: Column, buckets: int = BUCKETS) -> Batch:
    """Micro-batch step: records found on pages (page_id, url, html), matched to the kept companies or given the next ids.

    A matched company keeps its id and its ``first_seen_at``; its other values are those found last.  Evidence rows say on
    which page each value was found.  A replayed batch changes nothing; a batch without records writes no bucket.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        ledger = Ledger(df.sparkSession, folder)
        number, content = ledger.newest()
        mark = batch_mark(df, batch_id)
        if is_replay(content, mark):
            return
        content = content or _empty() | {"buckets": buckets}
        records, _ = found_records(html.parse_pages(df.select("page_id", "url", "html")))
        stored = ledger.spark.read.schema(COMPANY).parquet(ledger.write(candidates_of(ledger, content, records), "candidates"))
        # ids go on after the largest one in use, which may be among rows that were not read
        top = df.sparkSession.createDataFrame([(str(content["top"]),)], "id string").select(
            *[F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(COMPANY)]
        )
        found_at = ledger.write(placed_records(records, stored, as_of, stored.select("id").unionByName(top.select("id"))), "found")
        found = ledger.spark.read.parquet(found_at)
        content = _with_companies(ledger, content, found)
        content = content | {"evidence": _added(ledger, "evidence", content["evidence"], listed_evidence(found), EVIDENCE)}
        ledger.commit(number + 1, with_mark(content, mark))

    return batch

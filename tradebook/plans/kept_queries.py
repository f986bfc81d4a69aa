"""Queries over tables that streams keep, bulk search for pieces, versions, cursors and JSON paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions.json_paths import json_set
from tradebook.operators import pieces, versions
from tradebook.operators import search as se
from tradebook.plans import page_queries as pq
from tradebook.plans import result_queries as rq
from tradebook.plans.metric_queries import RATE_LIMIT_SQL
from tradebook.plans.registry import query, table
from tradebook.session import scratch_folder
from tradebook.streaming import buckets, limits, segments
from tradebook.streaming import streams as st

_FILES = 3


def _in_files(df, folder, part):
    """Write rows as files one after the other, so that a stream takes each as a batch."""
    for k in range(_FILES):
        df.where(part == k).coalesce(1).write.mode("append").parquet(folder)


def _worked_off(spark, df, part, name, step):
    folder = scratch_folder(spark, name)
    _in_files(df, f"{folder}/in", part)
    stream = st.file_stream(spark, f"{folder}/in", df.schema, files_per_batch=1)
    st.run_to_end(stream.writeStream.foreachBatch(step(f"{folder}/kept")), f"{folder}/checkpoint")
    return f"{folder}/kept"


@query(
    "stream_discovery",
    """WITH m AS (SELECT max(p_partkey) + 100001 AS top FROM part WHERE p_partkey % 3 = 0)
SELECT p_name || ' ' || p_partkey AS name_en, 'https://list.example.org/c/' || p_partkey AS website_url, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 100001 END AS stored_id,
  CASE WHEN p_partkey % 3 = 0 THEN '2023-01-01' ELSE '2024-02-01' END AS first_seen, 1::BIGINT AS rows_of_id, 2::BIGINT AS n_evidence FROM part""",
)
def stream_discovery(spark, sf_dir):
    """Companies found on listing pages in several batches: kept ids and first dates, one row an id, evidence of each value."""
    pages = pq._listing(spark, sf_dir, rq._DISCOVER_ITEM, "", "").select("page_id", "url", "html")
    stored = rq._stored_companies(spark, sf_dir)

    def step(folder):
        buckets.load_companies(spark, folder, stored)
        return buckets.discovery_step(folder, rq._as_of())

    folder = _worked_off(spark, pages, F.col("page_id") % _FILES, "stream-discovery", step)
    top = stored.agg(F.max(F.col("id").cast("long")).alias("top"))
    n = buckets.kept_evidence(spark, folder).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n_evidence"))
    companies = buckets.kept_companies(spark, folder)
    ids = companies.groupBy("id").agg(F.count("*").alias("rows_of_id"))
    return companies.join(ids, "id").join(n, "id").crossJoin(F.broadcast(top)).select(
        "name_en", "website_url", F.when(F.col("id").cast("long") <= F.col("top"), F.col("id").cast("long")).alias("stored_id"),
        F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"), "rows_of_id", "n_evidence",
    )


@query("stream_limited", RATE_LIMIT_SQL)
def stream_limited(spark, sf_dir):
    """The call limit over a stream whose batches overlap in time: the verdicts of the batch form."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).alias("caller"))
    ends = e.agg(F.min(F.unix_millis("ts")).alias("a"), F.max(F.unix_millis("ts")).alias("b")).first()
    width = (ends["b"] - ends["a"]) // _FILES + 1
    # every other call comes a third of a batch late
    part = F.least(F.floor((F.unix_millis("ts") - ends["a"] + F.when(F.col("event_id") % 2 == 0, width // 3).otherwise(0)) / width), F.lit(_FILES - 1))
    window, most = 6 * 3600 * 1000, 20
    folder = _worked_off(spark, e, part, "stream-limited", lambda f: limits.limit_step(f, "caller", "event_id", "ts", window, most, width))
    limits.finish(spark, folder, window, most)
    return limits.verdicts(spark, folder).select(F.col("call_id").alias("event_id"), "allowed")


_PIECE = "regexp_replace(lower(substring(text, 3, 24)), '[^\\w\\s]', ' ', 'g')"
_PIECES_SQL = f"""WITH d AS (SELECT doc_id AS id, {rq._SEARCHABLE} AS t FROM documents),
q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(trim({_PIECE}), '\\s+'), lambda w: w <> '')) AS terms FROM benchmark)
SELECT query_id, id FROM q JOIN d ON len(terms) > 0 AND len(list_filter(terms, lambda w: NOT contains(t, w))) = 0"""


def _piece_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.regexp_replace(F.lower(F.substring("text", 3, 24)), r"[^\w\s]", " ").alias("query")
    )


@query("search_pieces", _PIECES_SQL)
def search_pieces(spark, sf_dir):
    """Pieces of words of every passage, looked for in all texts at once."""
    index, queries = rq._index(spark, sf_dir), _piece_queries(spark, sf_dir)
    return pieces.search_pieces(queries, pieces.postings(index, ["id"], asked=pieces.cover(queries)), ["id"])


@query("stream_index", _PIECES_SQL)
def stream_index(spark, sf_dir):
    """The same search over an index that a stream kept by segments; each text came first in another wording."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name_en"), F.col("lang").alias("business_type"), F.col("text").alias("description_en")
    )
    old = d.withColumn("description_en", F.lit("an older wording")).withColumn("part", F.lit(0))
    gone = d.withColumn("id", -F.col("id") - 1).withColumn("part", F.lit(1)).withColumn("description_en", F.concat(F.lit("taken away "), F.substring("description_en", 1, 9)))
    new = d.withColumn("part", 1 + F.col("id") % 2)
    rows = old.unionByName(new).unionByName(gone.withColumn("part", F.lit(0))).unionByName(gone)
    rows = rows.withColumn("deleted", (F.col("id") < 0) & (F.col("part") == 1))
    folder = _worked_off(spark, rows, F.col("part"), "stream-index", lambda f: segments.index_stream(f, rq._as_of(), F.col("deleted")))
    return segments.search_segments(spark, folder, _piece_queries(spark, sf_dir))


@query(
    "changed_rows",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'gone' ELSE 'changed' END AS change FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0
UNION ALL SELECT p_partkey + 1000000000, 'added' FROM part WHERE p_partkey % 11 = 0""",
)
def changed_rows(spark, sf_dir):
    """What differs between two versions of a table: some rows changed, some gone, some new."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id").withColumn("id", F.col("id").cast("long"))
    kept = p.where("id % 7 <> 0").withColumn("p_retailprice", F.when(F.col("id") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    added = p.where("id % 11 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return versions.changed_rows(p, kept.unionByName(added), ["id"])


@query("page_by_cursor", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_by_cursor(spark, sf_dir):
    """The third page of fifty, found from the last row of the second."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    order, cursor = [("o_totalprice", True), ("o_orderkey", False)], None
    for _ in range(2):
        cursor = versions.next_cursor(versions.page_after(o, order, 50, cursor).collect(), order, 50)
    return versions.page_after(o, order, 50, cursor)


@query(
    "json_set",
    """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_id AS seen, 'v' || event_id % 3 AS tag,
  (1 + CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_fields FROM events""",
)
def json_set_query(spark, sf_dir):
    """Two values set under a parent that is made on the way; the fields that were there stay."""
    e = table(spark, sf_dir, "events")
    once = json_set(F.col("props"), ["meta", "seen"], F.col("event_id").cast("variant"))
    twice = json_set(once, ["meta", "tag"], F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).cast("variant"))
    doc = F.try_parse_json("doc")
    get = lambda path, kind: F.try_variant_get(doc, path, kind)
    return e.select("event_id", twice.alias("doc")).select(
        "event_id", get("$.k", "bigint").alias("k"), get("$.meta.seen", "bigint").alias("seen"), get("$.meta.tag", "string").alias("tag"),
        F.size(F.json_object_keys("doc")).cast("long").alias("n_fields"),
    )

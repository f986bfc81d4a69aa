"""Queries of job states, seeds in progress, generated keys, JSON files written and read back, call logs and single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import text as tx
from tradebook.operators import crawl, evidence
from tradebook.operators import tables as tb
from tradebook.plans.registry import query, table
from tradebook.session import scratch_folder
from tradebook.sources import readers as rd
from tradebook.sources import writers as wr


def _as_of():
    return F.lit("1996-01-01 00:00:00").cast("timestamp")


_JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS id, o_orderpriority AS queue_name, (o_custkey % 10)::INT AS priority, (o_orderkey % 6)::INT AS attempts, o_orderdate AS scheduled_at,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status
  FROM orders)"""


def _jobs(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("queue_name"), (F.col("o_custkey") % 10).cast("int").alias("priority"),
        (F.col("o_orderkey") % 6).cast("int").alias("attempts"), F.col("o_orderdate").alias("scheduled_at"), state.alias("status"),
    )


@query(
    "jobs_claimed",
    f"WITH {_JOBS_SQL} SELECT id, queue_name, priority FROM jobs WHERE status = 'pending' AND scheduled_at <= TIMESTAMP '1996-01-01' ORDER BY priority DESC, scheduled_at, id LIMIT 100",
)
def jobs_claimed(spark, sf_dir):
    """The hundred due jobs that workers take next; the limit is the feature."""
    return crawl.claim_order(_jobs(spark, sf_dir), _as_of(), 100).select("id", "queue_name", "priority")


@query(
    "jobs_reset",
    f"""WITH {_JOBS_SQL}, again AS (SELECT *, queue_name = '1-URGENT' AND status = 'failed' AS back FROM jobs)
SELECT id, queue_name, CASE WHEN back THEN 'pending' ELSE status END AS status, CASE WHEN back THEN 0 ELSE attempts END::INT AS attempts,
  back OR scheduled_at = TIMESTAMP '1996-01-01' AS due_now FROM again""",
)
def jobs_reset(spark, sf_dir):
    """The whole job table after the failed jobs of one queue are set back to pending."""
    jobs = _jobs(spark, sf_dir)
    after = tb.upsert(jobs, crawl.reset_failed(jobs, "1-URGENT", _as_of()).select(*jobs.columns), ["id"])
    return after.select("id", "queue_name", "status", "attempts", (F.col("scheduled_at") == _as_of()).alias("due_now"))


@query("fetch_waits", f"WITH {_JOBS_SQL} SELECT id, attempts, least(1000 * pow(2, attempts), 20000)::BIGINT AS wait_ms FROM jobs")
def fetch_waits(spark, sf_dir):
    """Wait before the next fetch of every job, capped at 20 s."""
    return _jobs(spark, sf_dir).select("id", "attempts", crawl.backoff_ms(F.col("attempts"), 1000, 20_000).alias("wait_ms"))


@query(
    "seeds_moved",
    """SELECT 'https://' || lower(replace(s_name, '#', '-')) || '.example.org/' AS canonical_url,
  CASE WHEN s_acctbal > 5000 THEN 'completed' WHEN s_acctbal > 2000 THEN 'failed' WHEN s_acctbal > 0 THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN s_acctbal > 0 THEN s_nationkey ELSE 0 END::INT AS companies_found, s_acctbal > 2000 AS processed FROM supplier""",
)
def seeds_moved(spark, sf_dir):
    """The seed table after a crawl told of the seeds with a balance; the others stay as they were."""
    s = table(spark, sf_dir, "supplier")
    url = F.concat(F.lit("https://"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example.org/")).alias("canonical_url")
    seeds = s.select(url, F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("processed_at"), F.lit(0).alias("companies_found"))
    state = F.when(F.col("s_acctbal") > 5000, "completed").when(F.col("s_acctbal") > 2000, "failed").otherwise("processing")
    moves = s.where("s_acctbal > 0").select(url, state.alias("status"), F.col("s_nationkey").cast("int").alias("companies_found"))
    moved = crawl.move_seeds(seeds, moves, _as_of())
    return moved.select("canonical_url", "status", "companies_found", F.col("processed_at").isNotNull().alias("processed"))


@query(
    "generated_keys",
    "SELECT p_partkey, sha256(p_name || '|' || coalesce(nullif(p_brand, 'Brand#11'), '∅') || '|' || p_size) AS id FROM part",
)
def generated_keys(spark, sf_dir):
    """Rows that come without a key get one of their own values; a missing value is a value of its own."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.expr("nullif(p_brand, 'Brand#11')").alias("p_brand"), "p_size")
    return tb.with_generated_key(rows, ["p_name", "p_brand", "p_size"]).select("p_partkey", "id")


@query("json_written", "SELECT c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal FROM customer")
def json_written(spark, sf_dir):
    """Chosen columns of all customers written as JSON, nulls kept, and read back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"), "c_acctbal")
    path = scratch_folder(spark, "json-export")
    wr.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("payload_total", "SELECT count(*) AS total, '/api/companies' AS endpoint FROM customer")
def payload_total(spark, sf_dir):
    """The head of the nested export over all customers."""
    return wr.payload_header(table(spark, sf_dir, "customer"), _as_of()).select("total", "endpoint")


@query(
    "tables_dumped",
    """SELECT 'customer' AS name, c_custkey::BIGINT AS id, c_name AS label FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part""",
)
def tables_dumped(spark, sf_dir):
    """Three tables dumped as JSON, one folder each, and read back."""
    folder, out = scratch_folder(spark, "dump"), None
    keys = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    dumped = {name: table(spark, sf_dir, name) for name in keys}
    wr.dump_tables(dumped, folder)
    for name, (key, label) in keys.items():
        back = spark.read.schema(dumped[name].schema).json(f"{folder}/{name}")
        rows = back.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stored_row", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def stored_row(spark, sf_dir):
    """The row of one key; the condition reaches the scan."""
    return rd.one_row(table(spark, sf_dir, "orders"), "o_orderkey", 33).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "captured_responses",
    """SELECT p_partkey // 7 AS page_id, (row_number() OVER (PARTITION BY p_partkey // 7 ORDER BY p_partkey) - 1)::INT AS pos,
  '{"name":"' || p_name || '","size":' || p_size || '}' AS body FROM part""",
)
def captured_responses(spark, sf_dir):
    """JSON responses that were captured with each page, every one of them, a row each."""
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    items = table(spark, sf_dir, "part").select(F.expr("p_partkey div 7").alias("page_id"), F.struct("p_partkey", body.alias("body")).alias("item"))
    pages = items.groupBy("page_id").agg(F.array_sort(F.collect_list("item")).alias("items"))  # seven a page
    return rd.captured_json(pages.select("page_id", F.col("items.body").alias("network_json"))).select("page_id", "pos", "body")


@query(
    "provider_calls",
    """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, props AS request_payload, event_type AS response_payload
FROM events""",
)
def provider_calls(spark, sf_dir):
    """Calls of a provider as log rows, payloads whole."""
    failed = F.when(F.col("event_type") == "error", F.lit("refused"))
    calls = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), failed.alias("error_message"), F.col("props").alias("request_payload"), F.col("event_type").alias("response_payload")
    )
    return evidence.provider_log(calls).select("id", "status", "request_payload", "response_payload")


@query(
    "path_languages",
    """WITH paths AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '/ar/' WHEN 1 THEN '/en/' WHEN 2 THEN '/arts/' ELSE '/' END || lower(replace(p_name, ' ', '-')) AS path FROM part)
SELECT p_partkey, CASE WHEN path LIKE '/ar/%' THEN 'ar' ELSE 'en' END AS language FROM paths""",
)
def path_languages(spark, sf_dir):
    """Language of a public path; a longer first part is no language."""
    start = F.expr("CASE p_size % 4 WHEN 0 THEN '/ar/' WHEN 1 THEN '/en/' WHEN 2 THEN '/arts/' ELSE '/' END")
    path = F.concat(start, F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))))
    return table(spark, sf_dir, "part").select("p_partkey", tx.language_of_path(path).alias("language"))

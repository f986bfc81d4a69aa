"""Queries over events and jobs: counters, gauges, histograms, health, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.operators import metrics as mt
from tradebook.plans import views as v
from tradebook.plans.registry import query, table


def _points(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("metric"), "value", "ts", F.col("event_id").alias("ordinal"), F.col("user_id"),
        mt.tags_key(F.create_map(F.lit("user"), (F.col("user_id") % 5).cast("string"))).alias("tags_key"),
    )


_TAG = """'{"user":"' || (user_id % 5) || '"}'"""


@query("counters", f"SELECT event_type AS metric, {_TAG} AS tags_key, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def counters(spark, sf_dir):
    """Sum of every counter by its tags."""
    return mt.counters(_points(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query("gauges", f"SELECT event_type AS metric, {_TAG} AS tags_key, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def gauges(spark, sf_dir):
    """Last value of every gauge."""
    return mt.gauges(_points(spark, sf_dir))


@query(
    "histogram_stats",
    f"""WITH p AS (SELECT event_type AS metric, {_TAG} AS tags_key, value, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts DESC, event_id DESC) AS rn FROM events),
g AS (SELECT metric, tags_key, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, list_sort(list(value)) AS v FROM p WHERE rn <= 1000 GROUP BY 1, 2)
SELECT metric, tags_key, n, mean, min, max, v[floor(n * 0.5)::BIGINT + 1] AS p50, v[floor(n * 0.9)::BIGINT + 1] AS p90, v[floor(n * 0.99)::BIGINT + 1] AS p99 FROM g""",
)
def histogram_stats(spark, sf_dir):
    """Statistics of the last thousand values of every metric."""
    return mt.histogram_stats(_points(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("recent_points", "SELECT event_id AS ordinal, event_type AS metric FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def recent_points(spark, sf_dir):
    """The newest ten thousand points."""
    return mt.recent_points(_points(spark, sf_dir)).select("ordinal", "metric")


def _parses(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("adapter_id"), (F.col("user_id") % 3 != 0).alias("success"),
        (F.col("event_id") % 7).alias("companies_found"), F.col("value").alias("parse_time_ms"), "ts", F.col("event_id").alias("ordinal"),
    )


@query(
    "adapter_stats",
    """SELECT event_type AS adapter_id, count(*) AS total, count_if(user_id % 3 <> 0)::BIGINT AS successes, count_if(user_id % 3 = 0)::BIGINT AS failures,
  round(count_if(user_id % 3 <> 0)::DOUBLE / count(*), 9) AS success_rate, round(sum(event_id % 7)::DOUBLE / count(*), 9) AS items_per_parse, floor(avg(value) + 0.5)::BIGINT AS mean_time_ms FROM events GROUP BY 1""",
)
def adapter_stats(spark, sf_dir):
    out = mt.adapter_stats(_parses(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("success_rate", "items_per_parse")})


@query(
    "event_points",
    """WITH p AS (SELECT 'adapter.parse_total' AS metric, event_type AS t, 1.0 AS v FROM events UNION ALL SELECT 'adapter.parse_success', event_type, 1 FROM events WHERE user_id % 3 <> 0
  UNION ALL SELECT 'adapter.parse_failure', event_type, 1 FROM events WHERE user_id % 3 = 0 UNION ALL SELECT 'adapter.companies_found', event_type, event_id % 7 FROM events WHERE event_id % 7 > 0
  UNION ALL SELECT 'adapter.parse_time_ms', event_type, value FROM events)
SELECT metric, '{"adapter_id":"' || t || '"}' AS tags_key, round(sum(v), 3)::DOUBLE AS total FROM p GROUP BY ALL""",
)
def event_points(spark, sf_dir):
    """Parse events fanned out to their metrics and summed."""
    out = mt.counters(mt.event_points(_parses(spark, sf_dir), "parse"))
    return out.withColumn("total", F.round("total", 3))


@query(
    "token_budget",
    "SELECT event_type AS provider, strftime(ts, '%Y-%m-%d') AS day, (sum(user_id) * 100)::BIGINT AS tokens, sum(user_id) * 100 > 100000 AS over_budget FROM events GROUP BY 1, 2",
)
def token_budget(spark, sf_dir):
    """Tokens per provider and day against a budget."""
    u = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), "ts", (F.col("user_id") * 100).alias("tokens"))
    return mt.token_budget(u, 100_000).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "queue_size",
    """WITH e AS (SELECT event_id, ts, 'q' || (user_id % 3) AS queue, CASE WHEN event_type IN ('click', 'view') THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END AS step FROM events)
SELECT event_id, queue, sum(step) OVER (PARTITION BY queue ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS size FROM e""",
)
def queue_size(spark, sf_dir):
    """Size of each queue after every event."""
    action = F.when(F.col("event_type").isin("click", "view"), "enqueued").when(F.col("event_type") == "purchase", "dequeued").otherwise("failed")
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")).alias("queue"), action.alias("action"))
    return mt.queue_size(e, ["ts", "event_id"]).select("event_id", "queue", "size")


@query(
    "regional_health",
    """WITH j AS (SELECT o_orderpriority AS region, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 977 * 1000 END AS ms FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
r AS (SELECT DISTINCT o_orderpriority AS region FROM orders UNION ALL SELECT r_name FROM region)
SELECT r.region, CASE WHEN count(status) = 0 THEN 100.0 ELSE round(count_if(status = 'completed')::DOUBLE / greatest(count_if(status IN ('completed', 'failed')), 1) * 100, 6) END::DOUBLE AS success_rate,
  count(status) AS total, coalesce(count_if(status = 'completed'), 0)::BIGINT AS succeeded, coalesce(count_if(status = 'failed'), 0)::BIGINT AS failed, coalesce(count_if(status = 'running'), 0)::BIGINT AS running,
  floor(coalesce(avg(ms), 0) + 0.5)::BIGINT AS mean_duration_ms FROM r LEFT JOIN j USING (region) GROUP BY r.region""",
)
def regional_health(spark, sf_dir):
    """Health of every region; regions without jobs are there with rate 100."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(
        F.col("o_orderpriority").alias("region"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN timestampadd(SECOND, cast(o_orderkey % 977 as int), o_orderdate) END").alias("completed_at"),
    )
    regions = o.select(F.col("o_orderpriority").alias("region")).distinct().union(table(spark, sf_dir, "region").select("r_name"))
    out = mt.regional_health(jobs, regions, F.lit("1998-01-01").cast("timestamp"))
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "run_totals",
    """WITH p AS (SELECT l_suppkey AS run_id, CASE WHEN l_suppkey % 10 = 0 THEN 'blocked' WHEN l_suppkey % 10 = 1 OR (l_returnflag = 'R' AND l_suppkey % 2 = 0) THEN 'failed' ELSE 'saved' END AS outcome FROM lineitem),
t AS (SELECT run_id, count(*) AS pages, count_if(outcome = 'saved')::BIGINT AS saved, count_if(outcome = 'failed')::BIGINT AS failed, count_if(outcome = 'blocked')::BIGINT AS blocked FROM p GROUP BY 1)
SELECT *, CASE WHEN blocked = pages THEN 'blocked' WHEN saved = 0 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status FROM t""",
)
def run_totals(spark, sf_dir):
    """Totals and status of every crawl run; suppliers stand for runs."""
    p = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS run_id",
        "CASE WHEN l_suppkey % 10 = 0 THEN 'blocked' WHEN l_suppkey % 10 = 1 OR (l_returnflag = 'R' AND l_suppkey % 2 = 0) THEN 'failed' ELSE 'saved' END AS outcome",
    )
    return mt.run_totals(p)


@query(
    "status_breakdown",
    f"""WITH {v.RICH_SQL} SELECT count(*) AS total, count_if(status = 'approved')::BIGINT AS approved, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'rejected')::BIGINT AS rejected, count_if(is_verified)::BIGINT AS verified FROM rich""",
)
def status_breakdown(spark, sf_dir):
    return mt.status_breakdown(v.rich(spark, sf_dir))


@query(
    "system_summary",
    f"""WITH a AS (SELECT event_type AS adapter_id, count(*) AS total, count_if(user_id % 3 <> 0) AS ok, sum(event_id % 7) AS found FROM events GROUP BY 1)
SELECT 'counter' AS kind, event_type AS name, {_TAG} AS tags_key, round(sum(value), 4)::DOUBLE AS value FROM events GROUP BY ALL
UNION ALL SELECT 'gauge', event_type, {_TAG}, round(arg_max(value, event_id), 4) FROM events GROUP BY ALL
UNION ALL SELECT 'adapter', 'total', adapter_id, total FROM a UNION ALL SELECT 'adapter', 'successes', adapter_id, ok FROM a UNION ALL SELECT 'adapter', 'failures', adapter_id, total - ok FROM a
UNION ALL SELECT 'adapter', 'success_rate', adapter_id, round(ok::DOUBLE / total, 4) FROM a UNION ALL SELECT 'adapter', 'items_per_parse', adapter_id, round(found::DOUBLE / total, 4) FROM a""",
)
def system_summary(spark, sf_dir):
    """All counters, gauges and adapter figures in one table."""
    p = _points(spark, sf_dir)
    return mt.system_summary(p, p, _parses(spark, sf_dir)).withColumn("value", F.round("value", 4))


RATE_LIMIT_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id % 3 AS k, epoch_ms(ts) AS t, ts FROM events),
starts(k, t) AS (SELECT k, min(t) FROM e GROUP BY k UNION ALL SELECT s.k, (SELECT min(e.t) FROM e WHERE e.k = s.k AND e.t >= s.t + 21600000) FROM starts s WHERE EXISTS (SELECT 1 FROM e WHERE e.k = s.k AND e.t >= s.t + 21600000))
SELECT event_id, row_number() OVER (PARTITION BY e.k, s.t ORDER BY ts, event_id) <= 20 AS allowed FROM e JOIN starts s ON s.k = e.k AND e.t >= s.t AND e.t < s.t + 21600000"""


@query("rate_limit", RATE_LIMIT_SQL)
def rate_limit(spark, sf_dir):
    """Calls under a limit of twenty per six hours from the first call on, per caller group."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 3).alias("caller"))
    return mt.limited_calls(e, "caller", "ts", "event_id", 6 * 3600 * 1000, 20).select("event_id", "allowed")

"""Counters, gauges, histograms and roll-ups over event, run and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions.fixed_values import DAILY_TOKEN_BUDGET
from tradebook.functions.semantics import millis, sorted_percentile
from tradebook.operators.keys import numbered, top_per_key

KEY = ["metric", "tags_key"]


def tags_key(tags: Column) -> Column:
    """Maps cannot be grouped: their entries in key order, as JSON."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def counters(points: DataFrame) -> DataFrame:
    return points.groupBy(*KEY).agg(F.sum("value").alias("total"))


def gauges(points: DataFrame) -> DataFrame:
    """Last value of every gauge; a later point of the same instant wins by its ordinal."""
    return points.groupBy(*KEY).agg(F.max_by("value", F.struct("ts", "ordinal")).alias("value"))


def histogram_stats(points: DataFrame, keep: int = 1000) -> DataFrame:
    """Count, mean, extremes and percentiles of the last ``keep`` values of every metric."""
    last = top_per_key(points, KEY, [F.col("ts").desc(), F.col("ordinal").desc()], keep)
    agg = last.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.sort_array(F.collect_list("value")).alias("_v"),  # at most ``keep`` values
    )
    return agg.select(
        *KEY, "n", "mean", "min", "max", *[sorted_percentile(F.col("_v"), p).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    )


def histogram_stats_all(points: DataFrame) -> DataFrame:
    """The same over all values, with approximate percentiles: one pass, any group size."""
    q = F.percentile_approx("value", [0.5, 0.9, 0.99], 10_000)
    agg = points.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), q.alias("_q")
    )
    return agg.select(*KEY, "n", "mean", "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p99"))])


def recent_points(points: DataFrame, limit: int = 10_000) -> DataFrame:
    return points.orderBy(F.col("ts").desc(), F.col("ordinal").desc()).limit(limit)


def adapter_stats(parses: DataFrame) -> DataFrame:
    """Per adapter: parses, successes, failures, success rate, items per parse, mean time in whole ms."""
    ok = F.col("success")
    return parses.groupBy("adapter_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"),
        (F.sum("companies_found") / F.count("*")).alias("items_per_parse"),
        F.floor(F.avg("parse_time_ms") + 0.5).cast("long").alias("mean_time_ms"),
    )


def event_points(events: DataFrame, kind: str) -> DataFrame:
    """The metric points one event row fans out to."""
    c = F.col

    def point(metric: str, value: Column | float, tags: dict[str, Column] | None = None, cond: Column | None = None) -> Column:
        tag_map = F.to_json(F.create_map(*[x for k, t in sorted(tags.items()) for x in (F.lit(k), t)])) if tags else F.lit("{}")
        v = value if isinstance(value, Column) else F.lit(value)
        p = F.struct(F.lit(metric).alias("metric"), v.cast("double").alias("value"), tag_map.alias("tags_key"))
        return p if cond is None else F.when(cond, p)

    shapes = {
        "parse": lambda t={"adapter_id": c("adapter_id")}: [
            point("adapter.parse_total", 1, t), point("adapter.parse_success", 1, t, c("success")),
            point("adapter.parse_failure", 1, t, ~c("success")),
            point("adapter.companies_found", c("companies_found"), t, c("companies_found") > 0),
            point("adapter.parse_time_ms", c("parse_time_ms"), t),
        ],
        "fetch": lambda t={"method": c("method")}: [
            point("fetch.total", 1, t), point("fetch.blocked_by_robots", 1, None, c("blocked")),
            point("fetch.success", 1, t, c("success")), point("fetch.failure", 1, t, ~c("success")),
            point("fetch.response_code", 1, {"code": c("code").cast("string")}, c("code").isNotNull()), point("fetch.time_ms", c("time_ms"), t),
        ],
        "queue": lambda: [point("queue.total", 1, {"queue": c("queue"), "action": c("action")})],
        "extract": lambda t={"field": c("field"), "method": c("method")}: [
            point("extract.success", 1, t, c("success")), point("extract.failed", 1, t, ~c("success")),
            point("extract.confidence", c("confidence") * 100, {"field": c("field")}),
        ],
        "provider": lambda t={"provider": c("provider"), "job_type": c("job_type")}: [
            point("ai.total", 1, t), point("ai.success", 1, t, c("success")), point("ai.failure", 1, t, ~c("success")),
            point("ai.duration_ms", c("duration_ms"), t),
            point("ai.tokens", c("tokens"), {"provider": c("provider")}, c("tokens") > 0),
            point("ai.tokens_total", c("tokens"), {"provider": c("provider")}, c("tokens") > 0),
        ],
        "validation": lambda: [
            point("validation.total", 1), point("validation.passed", 1, None, c("passed")), point("validation.failed", 1, None, ~c("passed")),
            point("validation.score", c("score") * 100), point("validation.flags", c("flags")),
        ],
    }
    points = F.explode(F.array_compact(F.array(*shapes[kind]())))
    return events.select("ts", "ordinal", points.alias("_p")).select("ts", "ordinal", "_p.*")


def token_budget(usage: DataFrame, budget: int = DAILY_TOKEN_BUDGET) -> DataFrame:
    """Tokens per provider and day, with a flag for days beyond the budget."""
    return usage.groupBy("provider", F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens")).withColumn(
        "over_budget", F.col("tokens") > budget
    )


def queue_size(events: DataFrame, order: list[str]) -> DataFrame:
    """Size of the queue after every event: enqueued +1, dequeued -1, all else 0."""
    step = F.when(F.col("action") == "enqueued", 1).when(F.col("action") == "dequeued", -1).otherwise(0)
    return numbered(events, order, ["queue"], "position", {"size": step})


def regional_health(jobs: DataFrame, regions: DataFrame, since: Column) -> DataFrame:
    """Per region: success rate, counts and mean duration since a moment; regions without jobs have rate 100."""
    recent = jobs.where(F.col("created_at") >= since)
    both = F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()
    ms = F.when(both, millis(F.col("completed_at")) - millis(F.col("started_at")))
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    per = recent.groupBy("region").agg(
        F.count("*").alias("total"), done.alias("succeeded"), failed.alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"), F.avg(ms).alias("_ms"),
    )
    # the region list is the small side of a table of a few rows
    out = regions.join(per, "region", "left").na.fill(0, ["total", "succeeded", "failed", "running"])
    rate = F.when(F.col("total") == 0, 100.0).otherwise(
        F.col("succeeded") / F.greatest(F.col("succeeded") + F.col("failed"), F.lit(1)) * 100
    )
    return out.select(
        "region", rate.alias("success_rate"), "total", "succeeded", "failed", "running",
        F.floor(F.coalesce("_ms", F.lit(0.0)) + 0.5).cast("long").alias("mean_duration_ms"),
    )


def run_totals(pages: DataFrame) -> DataFrame:
    """Per run: pages, saved, failed, and the status they amount to."""
    out = pages.groupBy("run_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("outcome") == "saved").alias("saved"),
        F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "blocked").alias("blocked"),
    )
    status = (
        F.when(F.col("blocked") == F.col("pages"), "blocked").when(F.col("saved") == 0, "failed")
        .when(F.col("failed") > 0, "partial").otherwise("completed")
    )
    return out.withColumn("status", status)


def status_breakdown(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "pending", "rejected")],
        F.count_if(F.col("is_verified")).alias("verified"),
    )


def system_summary(counter_points: DataFrame, gauge_points: DataFrame, parses: DataFrame) -> DataFrame:
    """All counters, gauges and adapter figures as (kind, name, tags_key, value) rows."""
    c = counters(counter_points).select(F.lit("counter").alias("kind"), F.col("metric").alias("name"), "tags_key", F.col("total").alias("value"))
    g = gauges(gauge_points).select(F.lit("gauge").alias("kind"), F.col("metric").alias("name"), "tags_key", "value")
    a = adapter_stats(parses)
    figures = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"))
        for n in ("total", "successes", "failures", "success_rate", "items_per_parse")
    ]))
    a = a.select(F.lit("adapter").alias("kind"), F.col("adapter_id").alias("tags_key"), figures.alias("_f")).select("kind", "_f.name", "tags_key", "_f.value")
    return c.unionByName(g).unionByName(a)


def limited_calls(events: DataFrame, key: str, ts: str, order: str, window_ms: int, most: int) -> DataFrame:
    """Fixed-window limit anchored at events: the first call opens a window, at most ``most`` calls pass in it."""
    placed = windows_of_calls(events, key, ts, order, window_ms)
    return placed.withColumn("allowed", F.col("position") <= most).drop("window_start")


def windows_of_calls(events: DataFrame, key: str, ts: str, order: str, window_ms: int) -> DataFrame:
    """Adds window_start (milliseconds) and position: the window each call falls in and its number there.

    Batch form over whole tables.  The window that follows one opened at t is
    opened by the first call at or after t + window.  Calls are placed on a grid
    of cells one window wide, where that call is the first one at or after the
    same offset in a later cell; jumps are then doubled, so the number of
    rounds grows with the logarithm of the number of windows and no key is worked
    through in one task.
    """
    from tradebook.session import checkpointed

    e = events.withColumn("_t", millis(F.col(ts)))
    times = checkpointed(e.select(F.col(key).alias("k"), F.col("_t").alias("t")).distinct())
    probes = times.select("k", (F.col("t") + window_ms).alias("at"), F.col("t").alias("from"))
    follow = _next_at_or_after(probes, times)
    jumps = checkpointed(follow.where("nxt is not null").select("k", F.col("from").alias("t"), "nxt"))
    opened = checkpointed(times.groupBy("k").agg(F.min("t").alias("t")))
    while True:
        more = opened.join(jumps, ["k", "t"]).select("k", F.col("nxt").alias("t"))
        grown = checkpointed(opened.union(more).distinct())
        second = jumps.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jumps = checkpointed(jumps.join(second, ["k", "nxt"]).select("k", "t", F.col("far").alias("nxt")))
        opened = grown
        if jumps.isEmpty():
            break
    # a call belongs to the last window opened at or before it; opened windows are few per cell
    width = F.lit(window_ms)
    cells = opened.select("k", F.col("t").alias("start"), F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1)).alias("cell"))
    placed = e.withColumns({"k": F.col(key), "cell": F.floor(F.col("_t") / width)}).join(cells, ["k", "cell"])
    inside = placed.where((F.col("start") <= F.col("_t")) & (F.col("_t") < F.col("start") + window_ms))
    named = inside.select(*events.columns, F.col("k").alias("_k"), "start")
    ranked = numbered(named, [ts, order], ["_k", "start"], "position")
    return ranked.select(*events.columns, F.col("start").alias("window_start"), "position")


def _next_at_or_after(probes: DataFrame, times: DataFrame) -> DataFrame:
    """Adds nxt: the smallest time of the key at or after ``at``, by one sorted pass over range partitions."""
    from pyspark.sql import Window

    from tradebook.session import checkpointed

    parts = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = probes.select("k", F.col("at").alias("t"), "from", F.lit(0).alias("is_time")).unionByName(
        times.select("k", "t", F.lit(None).cast("long").alias("from"), F.lit(1).alias("is_time"))
    )
    by = ["k", "t", "is_time", "from"]
    placed = checkpointed(
        both.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    # from the last row back: a frame that ends at the row grows, one that begins there is read anew for every row
    ahead = Window.partitionBy("_part", "k").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    time = F.when(F.col("is_time") == 1, F.col("t"))
    local = placed.withColumn("_n", F.last(time, ignorenulls=True).over(ahead))
    # first time of each key in each partition: one row per key and partition
    heads = placed.where("is_time = 1").groupBy("k", "_part").agg(F.min("t").alias("_head"))
    later = Window.partitionBy("k").orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.select("k", "_part").distinct().join(heads, ["k", "_part"], "left")
    carry = spans.withColumn("_carry", F.last("_head", ignorenulls=True).over(later)).select("k", "_part", "_carry")
    return (
        local.where("is_time = 0").join(carry, ["k", "_part"], "left")
        .select("k", F.col("from"), F.coalesce("_n", "_carry").alias("nxt"))
    )

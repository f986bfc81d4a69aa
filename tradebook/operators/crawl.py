"""Crawl bookkeeping as table transforms: robots rules, seeds, jobs, retries, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import urls
from tradebook.functions.semantics import blank_to_null, json_truthy, let, millis
from tradebook.operators.keys import numbered, ranked_per_key, top_per_key

# --- robots ------------------------------------------------------------------------------------


def robots_rules(texts: DataFrame) -> DataFrame:
    """(origin, text) -> one row per directive: origin, rule_no, agent, kind, value, line_no.

    A directive belongs to the user-agent line above it, so the text is cut at
    those lines and no window over lines is needed.
    """
    sections = texts.select("origin", F.posexplode(F.split("text", r"(?im)^(?=[ \t]*user-agent[ \t]*:)")).alias("rule_no", "body"))
    agent = F.trim(F.regexp_extract("body", r"(?i)^[ \t]*user-agent[ \t]*:([^\n#]*)", 1))
    lines = sections.where(F.col("body").rlike(r"(?i)^[ \t]*user-agent[ \t]*:")).select(
        "origin", "rule_no", agent.alias("agent"), F.posexplode(F.split("body", "\n")).alias("line_no", "line")
    )
    kind = F.lower(F.trim(F.regexp_extract("line", r"^([^:#]*):", 1)))
    value = F.trim(F.regexp_extract("line", r"^[^:#]*:([^#]*)", 1))
    return lines.select("origin", "rule_no", "agent", kind.alias("kind"), value.alias("value"), "line_no").where(
        F.col("kind").isin("user-agent", "allow", "disallow", "crawl-delay")
        & ((F.col("value") != "") | (F.col("kind") == "user-agent"))
    )


def path_pattern(value: Column) -> Column:
    """Regular expression of a robots path: '*' is any run, a final '$' anchors, '/' covers all."""
    body = F.regexp_replace(F.regexp_replace(value, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")))
    return F.when(value == "/", F.lit("^")).when(value.endswith("$"), F.concat(regex, F.lit("$"))).otherwise(regex)


def robots_policy(rules: DataFrame, agent: str) -> DataFrame:
    """One row per origin: the ordered checks that bind ``agent``, and its crawl delay in seconds.

    Rules naming the agent hide the '*' rules.  The array is bounded by the length
    of one robots file.
    """
    mine = rules.withColumn("own", (F.lower("agent") == agent.lower()).cast("int")).where(
        "own = 1 or agent = '*'"
    )
    checks = F.when(
        F.col("kind").isin("allow", "disallow"),
        F.struct(
            "own", "rule_no", F.when(F.col("kind") == "allow", 0).otherwise(1).alias("turn"), "line_no",
            path_pattern(F.col("value")).alias("pattern"),
        ),
    )
    delay = F.when(F.col("kind") == "crawl-delay", F.regexp_extract("value", r"^(\d+)", 1).try_cast("int"))
    # a later crawl-delay line of the same rule overwrites an earlier one
    per_rule = mine.groupBy("origin", "own", "rule_no").agg(
        F.collect_list(checks).alias("checks"), F.max_by(delay, F.when(delay.isNotNull(), F.col("line_no"))).alias("delay")
    )
    grouped = per_rule.groupBy("origin").agg(
        F.max("own").alias("own"),
        F.array_sort(F.flatten(F.collect_list("checks"))).alias("all_checks"),
        F.min_by(F.coalesce("delay", F.lit(0)), F.struct(-F.col("own"), F.col("rule_no"))).alias("crawl_delay"),
    )
    return grouped.select(
        "origin", F.filter("all_checks", lambda c: c["own"] == F.col("own")).alias("checks"), "crawl_delay"
    )


def robots_allowed(pages: DataFrame, policy: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed`` and ``crawl_delay``: the first check whose pattern fits the path decides."""
    placed = pages.withColumns({"_origin": urls.origin(F.col(url)), "_path": urls.path(F.col(url))})
    joined = placed.join(policy.withColumnRenamed("origin", "_origin"), "_origin", "left")
    hit = F.get(F.filter("checks", lambda c: F.regexp(F.col("_path"), c["pattern"])), F.lit(0))
    return joined.withColumns(
        {"allowed": F.coalesce(hit["turn"] == 0, F.lit(True)), "crawl_delay": F.coalesce("crawl_delay", F.lit(0))}
    ).drop("_origin", "_path", "checks")


# --- fetched pages ------------------------------------------------------------------------------


def is_challenge(html: Column) -> Column:
    """True for a page that tests for robots, refuses, or holds next to nothing; a null page holds nothing."""
    def judged(page: Column) -> Column:
        has = lambda words: [page.contains(w) for w in words]
        shield = page.contains(fv.CHALLENGE_HOST) & _any(has(fv.CHALLENGE_MARKS))
        puzzle = page.contains("captcha") & ~page.contains("recaptcha-badge")
        return shield | _any(has(fv.CHALLENGE_PHRASES)) | puzzle | (F.length(page) < fv.EMPTY_PAGE_LENGTH)

    return let(F.lower(F.coalesce(html, F.lit(""))), judged)


def is_firewall_page(html: Column) -> Column:
    """True for a page that an application firewall sent in place of the real one."""
    return let(F.lower(F.coalesce(html, F.lit(""))), lambda page: _any([page.contains(w) for w in fv.FIREWALL_PHRASES]))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def with_refusal(pages: DataFrame) -> DataFrame:
    """Adds ``refusal``: 'challenge', 'firewall' or null for a page that can be read.

    Readable pages go to extraction, the others to ``refusal_errors``.
    """
    return pages.withColumn(
        "refusal", F.when(is_challenge(F.col("html")), "challenge").when(is_firewall_page(F.col("html")), "firewall")
    )


ERROR_COLUMNS = ["run_id", "source_url", "error_type", "error_message", "html_snapshot", "screenshot_url"]


def error_rows(failures: DataFrame) -> DataFrame:
    """Failures as stored error rows; optional columns that are missing or empty are null."""
    return failures.select(
        *[(blank_to_null(F.col(c)) if c in failures.columns else F.lit(None).cast("string")).alias(c) for c in ERROR_COLUMNS]
    )


def refusal_errors(judged: DataFrame) -> DataFrame:
    """Error rows of the refused pages (run_id, url, html, refusal): 'failed_request' when nothing came, else 'blocked'."""
    nothing = F.coalesce(F.length("html"), F.lit(0)) == 0
    return error_rows(
        judged.where("refusal is not null").select(
            "run_id", F.col("url").alias("source_url"),
            F.when(nothing, "failed_request").otherwise("blocked").alias("error_type"),
            F.when(nothing, "No pages were returned by the scrape pipeline.")
            .otherwise("Target blocked the request or robots policy denied access.").alias("error_message"),
            F.col("html").alias("html_snapshot"),
        )
    )


def run_outcomes(outcomes: DataFrame) -> DataFrame:
    """One row per run from its (run_id, kind) rows; kind is 'page', 'saved', 'failed' or 'blocked'.

    A run with pages is partial or completed; one without is blocked or failed and
    counts as one failure.
    """
    n = outcomes.groupBy("run_id").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("page", "saved", "failed", "blocked")])
    empty, blocked = F.col("_page") == 0, F.col("_blocked") > 0
    return n.select(
        "run_id",
        F.when(empty & blocked, "blocked").when(empty, "failed").when(F.col("_failed") > 0, "partial").otherwise("completed").alias("status"),
        F.col("_page").alias("total_pages"),
        F.when(empty, 0).otherwise(F.col("_saved")).alias("total_success"),
        F.when(empty, 1).otherwise(F.col("_failed")).alias("total_failed"),
        F.when(empty & blocked, "Blocked").when(empty, "No results found").alias("error_message"),
    )


def with_home_page(pages: DataFrame, homes: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first ``k`` pages of a site as ``position`` 1 to k, the home page put first where none is among them.

    ``pages`` has the key, url, page_type and confidence; ``homes`` has (key, url),
    one row per site.  The second ranking sees at most k + 1 rows of a site.
    """
    best = ranked_per_key(pages, [key], order, k, "_rank").select(key, "url", "page_type", "confidence", "_rank")
    without = homes.join(best.where("page_type = 'homepage'").select(key).distinct(), key, "left_anti")
    added = without.select(key, "url", F.lit("homepage").alias("page_type"), F.lit(0.95).alias("confidence"), F.lit(0).alias("_rank"))
    return ranked_per_key(best.unionByName(added), [key], ["_rank"], k, "position").drop("_rank")


# --- seeds --------------------------------------------------------------------------------------


def seed_intake(found: DataFrame, known: DataFrame | None = None, order: str = "ordinal") -> DataFrame:
    """Valid addresses, one per canonical form, tagged, without those already known.

    ``found`` has url and an order column; ``known`` has canonical_url.
    """
    seeds = (
        found.where(urls.is_valid_url(F.col("url")))
        .withColumn("canonical_url", F.coalesce(urls.canonical_url(F.col("url")), F.col("url")))
        .withColumn("domain", F.coalesce(urls.domain(F.col("canonical_url")), F.lit("")))
    )
    if known is not None:
        seeds = seeds.join(known.select("canonical_url"), "canonical_url", "left_anti")
    first = top_per_key(seeds, ["canonical_url"], [order])
    return first.withColumns(
        {"tags": urls.seed_tags(F.col("domain")), "status": F.lit("pending"), "depth": F.lit(0), "max_depth": F.lit(2)}
    )


SEED_STATES = ["pending", "processing", "completed", "failed", "skipped"]


def seed_statistics(seeds: DataFrame) -> DataFrame:
    """One row: counts per state, sums over completed seeds, distinct domains."""
    done = F.col("status") == "completed"
    return seeds.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in SEED_STATES],
        F.coalesce(F.sum(F.when(done, F.col("companies_found"))), F.lit(0)).alias("companies_found"),
        F.coalesce(F.sum(F.when(done, F.col("pages_scraped"))), F.lit(0)).alias("pages_scraped"),
        F.count_distinct("domain").alias("domains"),
    )


def move_seeds(seeds: DataFrame, moves: DataFrame, as_of: Column) -> DataFrame:
    """Apply (canonical_url, status[, companies_found, pages_scraped, error]) to the seed table."""
    known = [c for c in ("companies_found", "pages_scraped", "error") if c in moves.columns]
    m = moves.select(
        "canonical_url", F.col("status").alias("_status"), *[F.col(c).alias(f"_{c}") for c in known]
    )
    finished = F.col("_status").isin("completed", "failed")
    out = seeds.join(m, "canonical_url", "left").withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "processed_at": F.when(finished, as_of).otherwise(F.col("processed_at")),
            **{c: F.coalesce(f"_{c}", c) for c in known},
        }
    )
    return out.select(*seeds.columns)


# --- jobs ---------------------------------------------------------------------------------------


def enqueue(jobs: DataFrame, requests: DataFrame, order: str) -> DataFrame:
    """Requests that become jobs: one per idempotency key, none while an unfinished job has the key.

    Requests without a key always become jobs.
    """
    keyed = top_per_key(requests.where("idempotency_key is not null"), ["idempotency_key"], [order])
    busy = jobs.where("status <> 'completed' and idempotency_key is not null").select("idempotency_key")
    fresh = keyed.join(busy, "idempotency_key", "left_anti").unionByName(requests.where("idempotency_key is null"))
    return fresh.withColumns({"status": F.lit("pending"), "attempts": F.lit(0)})


def evidence_fault(payload: Column) -> Column:
    """Why a job that stores evidence cannot run, or null: its JSON payload must name a company and hold evidence."""
    def judged(doc: Column) -> Column:
        named = json_truthy(doc, "$.company_id") | json_truthy(doc, "$.companyId")
        listed = F.schema_of_variant(F.try_variant_get(doc, "$.evidence", "variant")).startswith("ARRAY")
        first = F.try_variant_get(doc, "$.evidence[0]", "variant").isNotNull()
        proven = F.when(listed, first).otherwise(json_truthy(doc, "$.evidence"))
        return F.when(~F.coalesce(named, F.lit(False)), "Evidence store failed: missing company_id in payload").when(
            ~F.coalesce(proven, F.lit(False)), "Evidence store failed: missing evidence in payload"
        )

    return let(F.try_parse_json(payload), judged)


def judge_evidence_jobs(jobs: DataFrame) -> DataFrame:
    """Evidence jobs with their outcome: 'completed', or 'failed' with the reason as ``error_message``."""
    out = jobs.withColumn("error_message", evidence_fault(F.col("payload")))
    return out.withColumn("status", F.when(F.col("error_message").isNull(), "completed").otherwise("failed"))


def claim_order(jobs: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The pending, due jobs a worker would take next: priority, then age."""
    due = jobs.where((F.col("status") == "pending") & (F.col("scheduled_at") <= as_of))
    return due.orderBy(F.desc("priority"), "scheduled_at", "id").limit(limit)


def plan_retries(failures: DataFrame, as_of: Column, base_ms: int = 1000) -> DataFrame:
    """Next state of failed jobs: attempts + 1, wait base * 2^(n-1), dead letter at the maximum.

    No random jitter, so a rerun gives the same plan.
    """
    n = F.col("attempts") + 1
    dead = n >= F.col("max_attempts")
    wait = (F.lit(base_ms) * F.pow(F.lit(2.0), n - 1)).cast("long")
    return failures.withColumns(
        {
            "attempts": n,
            "status": F.when(dead, "dead_letter").otherwise("pending"),
            "wait_ms": F.when(~dead, wait),
            "scheduled_at": F.when(dead, as_of).otherwise(
                F.timestamp_millis(millis(as_of) + wait)
            ),
        }
    )


def backoff_ms(attempt: Column, base_ms: int = 1000, max_ms: int = 60_000) -> Column:
    """Exponential wait of a fetch attempt, capped."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), attempt), F.lit(float(max_ms))).cast("long")


def reset_failed(jobs: DataFrame, queue: str, as_of: Column, limit: int | None = None) -> DataFrame:
    """The failed jobs of a queue, set back to pending; ``limit`` takes the newest ones."""
    failed = jobs.where((F.col("queue_name") == queue) & (F.col("status") == "failed"))
    chosen = failed if limit is None else failed.orderBy(F.desc("created_at"), "id").limit(limit)
    return chosen.withColumns(
        {"status": F.lit("pending"), "attempts": F.lit(0), "scheduled_at": as_of}
    )


JOB_STATES = ["pending", "processing", "completed", "failed", "dead_letter"]


def queue_statistics(jobs: DataFrame, states: list[str] = JOB_STATES) -> DataFrame:
    """One row per queue with a count per state."""
    return jobs.groupBy("queue_name").agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def fetch_plan(pages: DataFrame, order: list, default_delay_ms: int = 2000) -> DataFrame:
    """Earliest start of every fetch of a domain when its delay is kept between fetches.

    ``delay_ms`` is constant per domain, so the start is delay * (position - 1).
    """
    placed = numbered(pages, order, ["domain"], "position")
    delay = F.coalesce("delay_ms", F.lit(default_delay_ms))
    return placed.withColumn("start_ms", (F.col("position") - 1) * delay)


FREQUENCY_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def due_schedules(schedules: DataFrame, as_of: Column) -> DataFrame:
    """Active schedules that are due, with their following run."""
    days = F.when(F.col("frequency") == "daily", 1)
    for name, n in FREQUENCY_DAYS.items():
        days = days.when(F.col("frequency") == name, n)
    due = schedules.where(F.col("is_active") & (F.col("next_run_at") <= as_of))
    return due.withColumns({"last_run_at": as_of, "next_run_at": F.timestamp_add("DAY", days, as_of)})

"""Queries over crawled pages: addresses, page types, best page per site, robots, seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import urls
from tradebook.functions.fixed_values import PAGE_TYPE_ORDER, PAGE_WEIGHTS, PAGE_WORDS, SEED_TAG_WORDS
from tradebook.operators import crawl
from tradebook.operators.keys import ranked_per_key, top_per_key
from tradebook.plans import views as v
from tradebook.plans.registry import query


@query(
    "site_best_page",
    f"""WITH {v.SITES_SQL}
SELECT domain, page_id, canonical_url, title, page_type, quality FROM (
  SELECT *, round(((CASE WHEN title <> '' THEN 1 ELSE 0 END) + 1 + (CASE WHEN page_type <> 'other' THEN 1 ELSE 0 END)) / 3.0, 2)::DOUBLE AS quality,
    row_number() OVER (PARTITION BY domain ORDER BY {v.case_sql('page_type', PAGE_TYPE_ORDER, 11)}, length(title) DESC, page_id) AS rn
  FROM sites) WHERE rn = 1""",
)
def site_best_page(spark, sf_dir):
    """The best page record of every site: page type, then title length, then page id."""
    sites = v.page_sites(spark, sf_dir).drop("html")
    best = top_per_key(
        sites,
        ["domain"],
        [urls.rank_of(F.col("page_type"), PAGE_TYPE_ORDER, 11), F.length("title").desc(), F.col("page_id")],
    )
    filled = F.when(F.col("title") != "", 1).otherwise(0) + 1 + F.when(F.col("page_type") != "other", 1).otherwise(0)
    return best.select(
        "domain", "page_id", "canonical_url", "title", "page_type", F.round(filled / 3.0, 2).alias("quality")
    )


@query("url_canonical", f"WITH {v.URL_PARTS_SQL} SELECT page_id, {v.CANONICAL_SQL} AS canonical_url FROM url_parts")
def url_canonical(spark, sf_dir):
    return v.pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))


@query("url_normal", f"WITH {v.URL_PARTS_SQL} SELECT page_id, {v.NORMAL_SQL} AS normal_url FROM url_parts")
def url_normal(spark, sf_dir):
    return v.pages(spark, sf_dir).select("page_id", urls.normal_url(F.col("url")).alias("normal_url"))


@query("url_untracked", f"WITH {v.URL_PARTS_SQL} SELECT page_id, {v.UNTRACKED_SQL} AS untracked_url FROM url_parts")
def url_untracked(spark, sf_dir):
    return v.pages(spark, sf_dir).select("page_id", urls.untracked_url(F.col("url")).alias("untracked_url"))


@query(
    "url_domain",
    f"""WITH {v.URL_PARTS_SQL}
SELECT page_id, regexp_replace(host, '^www\\.', '') AS domain, host AS source_domain, scheme || '://' || host AS origin FROM url_parts""",
)
def url_domain(spark, sf_dir):
    u = F.col("url")
    return v.pages(spark, sf_dir).select(
        "page_id", urls.domain(u).alias("domain"), urls.host(u).alias("source_domain"), urls.origin(u).alias("origin")
    )


@query(
    "url_valid",
    r"""SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS valid_as_is,
  regexp_matches('https://' || split_part(html, '>', 1), '^https?://[^\s/?#<>!]+([/?#]|$)') AS valid_other
FROM pages""",
)
def url_valid(spark, sf_dir):
    """Validity of the address itself and of a text that is none (the document type line)."""
    return v.pages(spark, sf_dir).select(
        "page_id",
        urls.is_absolute_url(F.col("url")).alias("valid_as_is"),
        urls.is_valid_url(F.split_part(F.col("html"), F.lit(">"), F.lit(1))).alias("valid_other"),
    )


@query(
    "url_dedupe",
    f"""WITH {v.URL_PARTS_SQL}, c AS (SELECT page_id, url, {v.CANONICAL_SQL} AS canonical_url FROM url_parts)
SELECT canonical_url, min(page_id) AS page_id, arg_min(url, page_id) AS url, count(*) AS copies FROM c GROUP BY canonical_url""",
)
def url_dedupe(spark, sf_dir):
    """One row per canonical address: the first original, and how many forms it has."""
    return (
        v.pages(spark, sf_dir)
        .select("page_id", "url", urls.canonical_url(F.col("url")).alias("canonical_url"))
        .groupBy("canonical_url")
        .agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"), F.count("*").alias("copies"))
    )


@query(
    "url_match_pairs",
    f"""WITH {v.URL_PARTS_SQL}, c AS (SELECT page_id, url, {v.CANONICAL_SQL} AS canonical_url FROM url_parts),
f AS (SELECT canonical_url, min(page_id) AS first_id FROM c GROUP BY 1)
SELECT first_id, page_id AS other_id FROM c JOIN f USING (canonical_url) WHERE page_id <> first_id""",
)
def url_match_pairs(spark, sf_dir):
    """Pages that point to the same resource, each paired with the first of them."""
    c = v.pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"))
    firsts = c.groupBy("canonical_url").agg(F.min("page_id").alias("first_id"))
    return (
        c.join(firsts, "canonical_url").where("page_id <> first_id").select("first_id", F.col("page_id").alias("other_id"))
    )


@query(
    "page_types",
    f"""WITH {v.SITES_SQL} SELECT page_id, page_type, type_confidence FROM sites""",
)
def page_types(spark, sf_dir):
    return v.page_sites(spark, sf_dir).select("page_id", "page_type", "type_confidence")


def _words_sql(rest: str) -> str:
    rows = [f"WHEN {rest} IN ('', '/', '/home', '/index.html') THEN 'homepage'"]
    for kind, words in PAGE_WORDS:
        rows.append("WHEN " + " OR ".join(f"contains({rest}, '{w}')" for w in words) + f" THEN '{kind}'")
    return f"(CASE {' '.join(rows)} ELSE 'other' END)"


@query(
    "page_types_by_words",
    f"""WITH {v.URL_PARTS_SQL}, r AS (SELECT page_id, replace(lower(url), scheme || '://' || host, '') AS rest FROM url_parts),
t AS (SELECT page_id, {_words_sql('rest')} AS page_type FROM r)
SELECT page_id, page_type, (CASE page_type WHEN 'homepage' THEN 1.0 WHEN 'other' THEN 0.1 ELSE 0.85 END)::DOUBLE AS confidence FROM t""",
)
def page_types_by_words(spark, sf_dir):
    k = urls.classify_page_by_words(F.col("url"), urls.origin(F.col("url")))
    return v.pages(spark, sf_dir).select("page_id", k.alias("k")).select("page_id", "k.page_type", "k.confidence")


@query(
    "page_topk",
    f"""WITH {v.SITES_SQL} SELECT domain, page_id, page_type, position FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {v.case_sql('page_type', PAGE_TYPE_ORDER, 11)}, type_confidence DESC, page_id) AS position
  FROM sites) WHERE position <= 5""",
)
def page_topk(spark, sf_dir):
    """The five pages of a site worth reading first."""
    sites = v.page_sites(spark, sf_dir).select("domain", "page_id", "page_type", "type_confidence")
    order = [urls.rank_of(F.col("page_type"), PAGE_TYPE_ORDER, 11), F.desc("type_confidence"), F.col("page_id")]
    out = ranked_per_key(sites, ["domain"], order, 5, "position")
    return out.select("domain", "page_id", "page_type", F.col("position").cast("long").alias("position"))


@query(
    "page_topk_weights",
    f"""WITH {v.URL_PARTS_SQL}, r AS (SELECT page_id, host, replace(lower(url), scheme || '://' || host, '') AS rest FROM url_parts),
t AS (SELECT page_id, host, {_words_sql('rest')} AS page_type FROM r)
SELECT host, page_id, page_type, position FROM (
  SELECT *, row_number() OVER (PARTITION BY host ORDER BY {v.case_sql('page_type', PAGE_WEIGHTS, 0)} DESC, page_id) AS position FROM t)
WHERE position <= 10""",
)
def page_topk_weights(spark, sf_dir):
    """The ten pages of a host by page weight, second rule set."""
    k = urls.classify_page_by_words(F.col("url"), urls.origin(F.col("url")))["page_type"]
    df = v.pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"), k.alias("page_type"))
    out = ranked_per_key(
        df, ["host"], [urls.rank_of(F.col("page_type"), PAGE_WEIGHTS, 0).desc(), F.col("page_id")], 10, "position"
    )
    return out.select("host", "page_id", "page_type", F.col("position").cast("long").alias("position"))


_TAGS_SQL = (
    "array_to_string(list_sort(list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN contains(domain, '{w}') THEN '{t}' END" for w, t in SEED_TAG_WORDS)
    + "], lambda x: x IS NOT NULL))), ',')"
)


@query(
    "seed_intake",
    f"""WITH {v.URL_PARTS_SQL}, c AS (SELECT page_id, url, {v.CANONICAL_SQL} AS canonical_url, regexp_replace(host, '^www\\.', '') AS domain FROM url_parts),
known AS (SELECT canonical_url FROM c WHERE page_id % 3 = 0),
f AS (SELECT canonical_url, min(page_id) AS page_id, any_value(domain) AS domain FROM c WHERE canonical_url NOT IN (SELECT canonical_url FROM known) GROUP BY 1)
SELECT canonical_url, page_id, domain, {_TAGS_SQL} AS tags FROM f""",
)
def seed_intake(spark, sf_dir):
    """Seeds from crawled addresses; a third of the pages stands for the seeds known already."""
    found = v.pages(spark, sf_dir).select("page_id", "url")
    known = found.where("page_id % 3 = 0").select(urls.canonical_url(F.col("url")).alias("canonical_url"))
    out = crawl.seed_intake(found, known, "page_id")
    return out.select("canonical_url", "page_id", "domain", F.array_join(F.sort_array("tags"), ",").alias("tags"))


_SEED_STATE = "CASE page_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'skipped' END"


@query(
    "seed_stats",
    f"""WITH {v.URL_PARTS_SQL}, s AS (SELECT {_SEED_STATE} AS status, length(html) % 7 AS found, page_id % 11 AS scraped,
  regexp_replace(host, '^www\\.', '') AS domain FROM url_parts)
SELECT count(*) AS total, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'processing')::BIGINT AS processing,
  count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'skipped')::BIGINT AS skipped,
  sum(CASE WHEN status = 'completed' THEN found END)::BIGINT AS companies_found,
  sum(CASE WHEN status = 'completed' THEN scraped END)::BIGINT AS pages_scraped, count(DISTINCT domain) AS domains FROM s""",
)
def seed_stats(spark, sf_dir):
    seeds = v.pages(spark, sf_dir).select(
        F.expr(_SEED_STATE).alias("status"),
        F.expr("length(html) % 7").alias("companies_found"),
        F.expr("page_id % 11").alias("pages_scraped"),
        urls.domain(F.col("url")).alias("domain"),
    )
    return crawl.seed_statistics(seeds)


_ROBOTS_TEXT = """concat('# made of the pages of the site\n', 'User-agent: *\nDisallow: /', lang, '/4\nAllow: /', lang, '/47\nCrawl-delay: ', n % 5,
  '\nUser-agent: directory-bot\n', CASE WHEN n % 2 = 0 THEN 'Allow: /*/5\nDisallow: /*/5*.html$\nDisallow: /de' ELSE 'Disallow:' END, '\n')"""

_ROBOTS_CHECK = """CASE WHEN n % 2 = 0 THEN (CASE WHEN regexp_matches(path, '^/.*/5') THEN true WHEN regexp_matches(path, '^/.*/5.*\\.html$') THEN false
  WHEN regexp_matches(path, '^/de') THEN false ELSE true END) ELSE true END"""
_ROBOTS_CHECK_ANY = """CASE WHEN starts_with(path, '/' || lang || '/47') THEN true WHEN starts_with(path, '/' || lang || '/4') THEN false ELSE true END"""


def _robots_texts(spark, sf_dir):
    """A robots text per origin, made of the languages and the number of its pages."""
    u = F.col("url")
    return (
        v.pages(spark, sf_dir)
        .select(urls.origin(u).alias("origin"), F.regexp_extract(u, r"^https?://[^/]*/([a-z]{2})/", 1).alias("lang"))
        .groupBy("origin")
        .agg(F.min("lang").alias("lang"), F.count("*").alias("n"))
        .select("origin", F.expr(_ROBOTS_TEXT).alias("text"))
    )


_ROBOTS_SQL = f"""WITH {v.URL_PARTS_SQL}, o AS (SELECT scheme || '://' || host AS origin, min(regexp_extract(url, '^https?://[^/]*/([a-z][a-z])/', 1)) AS lang, count(*) AS n
  FROM url_parts GROUP BY 1)
SELECT page_id, %s AS allowed, %s AS crawl_delay FROM url_parts u JOIN o ON o.origin = u.scheme || '://' || u.host"""


@query("robots_allowed", _ROBOTS_SQL % (_ROBOTS_CHECK, "0"))
def robots_allowed(spark, sf_dir):
    """May the directory's own agent fetch the page: its own rules hide the general ones."""
    policy = crawl.robots_policy(crawl.robots_rules(_robots_texts(spark, sf_dir)), "directory-bot")
    pages = v.pages(spark, sf_dir).select("page_id", "url")
    return crawl.robots_allowed(pages, policy).select("page_id", "allowed", "crawl_delay")


@query("robots_allowed_any", _ROBOTS_SQL % (_ROBOTS_CHECK_ANY, "(n % 5)::INTEGER"))
def robots_allowed_any(spark, sf_dir):
    """The same for an agent without rules of its own."""
    policy = crawl.robots_policy(crawl.robots_rules(_robots_texts(spark, sf_dir)), "some-bot")
    pages = v.pages(spark, sf_dir).select("page_id", "url")
    return crawl.robots_allowed(pages, policy).select("page_id", "allowed", "crawl_delay")


@query(
    "fetch_plan",
    f"""WITH {v.URL_PARTS_SQL}, p AS (SELECT page_id, regexp_replace(host, '^www\\.', '') AS domain, length(path) AS rank FROM url_parts),
d AS (SELECT domain, CASE WHEN count(*) % 2 = 0 THEN count(*) * 100 END AS delay_ms FROM p GROUP BY 1)
SELECT page_id, domain, row_number() OVER w AS position, (row_number() OVER w - 1) * coalesce(delay_ms, 2000) AS start_ms
FROM p JOIN d USING (domain) WINDOW w AS (PARTITION BY domain ORDER BY rank, page_id)""",
)
def fetch_plan(spark, sf_dir):
    """Start times of a polite crawl: shorter paths first, one delay per domain."""
    p = v.pages(spark, sf_dir).select(
        "page_id", urls.domain(F.col("url")).alias("domain"), F.length(urls.path(F.col("url"))).alias("rank")
    )
    delays = p.groupBy("domain").agg(F.expr("CASE WHEN count(*) % 2 = 0 THEN count(*) * 100 END").alias("delay_ms"))
    out = crawl.fetch_plan(p.join(delays, "domain"), ["rank", "page_id"])
    return out.select("page_id", "domain", "position", "start_ms")

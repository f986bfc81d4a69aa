"""Queries over fetched pages: refusals, errors and runs, links and names to skip, payloads, detail pages, guide pages.

The crawled pages are all readable, so the refused ones are made of them by what
a refusal adds; listings and their detail pages are written from the part table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import urls
from tradebook.operators import crawl
from tradebook.operators import extract as ex
from tradebook.operators import fields as fl
from tradebook.operators import html as h
from tradebook.plans import views as v
from tradebook.plans.page_queries import _PER_PAGE, _listing
from tradebook.plans.registry import query, table
from tradebook.session import spread

# --- refused pages -----------------------------------------------------------------------------------

# reads the same in both dialects
_FETCHED = """CASE page_id % 12 WHEN 1 THEN '<TITLE>Just a moment...</TITLE>' || html WHEN 2 THEN 'Cloudflare' || html || '<div id="cf-challenge">'
  WHEN 3 THEN 'cloudflare' || html WHEN 4 THEN 'Solve the CAPTCHA' || html WHEN 5 THEN 'captcha recaptcha-badge' || html WHEN 6 THEN substring(html, 1, 150)
  WHEN 7 THEN html || 'Mod_Security' WHEN 8 THEN html || 'Access Denied' WHEN 9 THEN '' WHEN 10 THEN html || 'Incapsula' ELSE html END"""

_REFUSAL_SQL = f"""f AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS run_id, url, {_FETCHED} AS html FROM pages),
j AS (SELECT *, CASE
    WHEN contains(lower(html), 'cloudflare') AND regexp_matches(html, '(?i)id="challenge-running"|id="cf-challenge"|__cf_chl_opt') THEN 'challenge'
    WHEN regexp_matches(html, '(?i)wait while we verify your browser|perimeterx|incapsula|distil networks|<title>(403 forbidden|access denied|just a moment\\.\\.\\.)</title>') THEN 'challenge'
    WHEN contains(lower(html), 'captcha') AND NOT contains(lower(html), 'recaptcha-badge') THEN 'challenge'
    WHEN length(html) < 200 THEN 'challenge'
    WHEN regexp_matches(html, '(?i)mod_security|not acceptable|access denied') THEN 'firewall' END AS refusal FROM f)"""


def _judged(spark, sf_dir):
    pages = v.pages(spark, sf_dir).select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("run_id"), "url", F.expr(_FETCHED).alias("html")
    )
    return crawl.with_refusal(pages)


@query("page_refusals", f"WITH {_REFUSAL_SQL} SELECT page_id, refusal FROM j")
def page_refusals(spark, sf_dir):
    """Which fetched pages are challenges, firewall answers or empty, and which can be read."""
    return _judged(spark, sf_dir).select("page_id", "refusal")


@query(
    "page_errors",
    f"""WITH {_REFUSAL_SQL} SELECT run_id, url AS source_url, CASE WHEN html = '' THEN 'failed_request' ELSE 'blocked' END AS error_type,
  CASE WHEN html = '' THEN 'No pages were returned by the scrape pipeline.' ELSE 'Target blocked the request or robots policy denied access.' END AS error_message,
  length(nullif(html, '')) AS snapshot_length, NULL::VARCHAR AS screenshot_url FROM j WHERE refusal IS NOT NULL""",
)
def page_errors(spark, sf_dir):
    """The error rows of the refused pages."""
    out = crawl.refusal_errors(_judged(spark, sf_dir))
    return out.withColumn("snapshot_length", F.length("html_snapshot").cast("long")).drop("html_snapshot")


@query(
    "run_outcomes",
    f"""WITH {_REFUSAL_SQL}, k AS (SELECT run_id || '/' || page_id % 40 AS run_id, CASE WHEN refusal IS NOT NULL THEN 1 ELSE 0 END AS refused, page_id % 3 = 0 AS saved, page_id % 17 = 0 AS failed FROM j),
n AS (SELECT run_id, count_if(refused = 0) AS pages, count_if(refused = 1) AS blocked, count_if(refused = 0 AND saved) AS saved, count_if(refused = 0 AND NOT saved AND failed) AS failed FROM k GROUP BY 1)
SELECT run_id, CASE WHEN pages = 0 THEN 'blocked' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status, pages::BIGINT AS total_pages,
  CASE WHEN pages = 0 THEN 0 ELSE saved END::BIGINT AS total_success, CASE WHEN pages = 0 THEN 1 ELSE failed END::BIGINT AS total_failed,
  CASE WHEN pages = 0 THEN 'Blocked' END AS error_message FROM n""",
)
def run_outcomes(spark, sf_dir):
    """Status and totals of every run; some have nothing but refused pages."""
    kinds = F.when(F.col("refusal").isNotNull(), F.array(F.lit("blocked"))).otherwise(
        F.array_compact(
            F.array(F.lit("page"), F.when(F.expr("page_id % 3 = 0"), "saved").when(F.expr("page_id % 17 = 0"), "failed"))
        )
    )
    run = F.concat_ws("/", "run_id", F.expr("page_id % 40").cast("string"))
    rows = _judged(spark, sf_dir).select(run.alias("run_id"), F.explode(kinds).alias("kind"))
    return crawl.run_outcomes(rows)


# --- links, names and ids to skip ----------------------------------------------------------------------

_LINK = """url || CASE page_id % 8 WHEN 0 THEN '.PDF' WHEN 1 THEN '/logo.png' WHEN 2 THEN '/a.js?v=1' WHEN 3 THEN '/main.css' WHEN 4 THEN '/sheet.xls'
  WHEN 5 THEN '/photo.jpeg' WHEN 6 THEN '/pdf' ELSE '' END"""


@query(
    "asset_links",
    f"SELECT page_id, regexp_matches(lower({_LINK}), '[.](jpe?g|png|gif|pdf|zip|docx|xlsx|css|js)$') AS is_asset FROM pages",
)
def asset_links(spark, sf_dir):
    """Links that are no pages: pictures, documents, styles, scripts."""
    return v.pages(spark, sf_dir).select("page_id", urls.is_asset(F.expr(_LINK)).alias("is_asset"))


_DOMAIN = """CASE c_custkey % 9 WHEN 0 THEN 'www.For-Sale-' || c_custkey || '.com' WHEN 1 THEN 'buydomain' || c_custkey || '.net' WHEN 2 THEN 'buy-website.org'
  WHEN 3 THEN 'Parked' || c_custkey || '.io' WHEN 4 THEN 'whois.example' WHEN 5 THEN 'domain-name-search.co' WHEN 6 THEN 'forresale.com' WHEN 7 THEN NULL ELSE 'firm' || c_custkey || '.sa' END"""


@query(
    "parked_names",
    """SELECT c_custkey AS id, c_custkey % 9 IN (0, 1, 2, 3, 4, 5) AS parked FROM customer""",
)
def parked_names(spark, sf_dir):
    """Domains whose very name says that they are parked or for sale."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_DOMAIN).alias("domain"))
    return c.select("id", urls.is_parked_name(F.col("domain")).alias("parked"))


_ID_TEXT = """CASE o_orderkey % 7 WHEN 0 THEN '' || (o_orderkey % 400 + 99800) WHEN 1 THEN '000' || (o_orderkey % 400 + 99800) WHEN 2 THEN (o_orderkey + 100001) || 'x'
  WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '-100005' ELSE (o_orderkey + 100001) || '99999999999999999999' END"""


@query(
    "public_id_check",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 IN (0, 1) THEN o_orderkey % 400 + 99800 >= 100001 ELSE o_orderkey % 7 = 6 END AS is_public FROM orders""",
)
def public_id_check(spark, sf_dir):
    """Texts that are public company ids: digits only, from the first public id on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_ID_TEXT).alias("text"))
    return o.select("id", urls.is_public_id(F.col("text")).alias("is_public"))


# --- evidence jobs --------------------------------------------------------------------------------------

_PAYLOAD = """CASE o_orderkey % 11 WHEN 0 THEN '{"company_id": "' || o_custkey || '", "evidence": [{"field": "email"}]}' WHEN 1 THEN '{"companyId": ' || o_custkey || ', "evidence": {"field": "email"}}'
  WHEN 2 THEN '{"company_id": "' || o_custkey || '"}' WHEN 3 THEN '{"company_id": "' || o_custkey || '", "evidence": []}' WHEN 4 THEN '{"company_id": "", "companyId": 0, "evidence": [1]}'
  WHEN 5 THEN 'no json' WHEN 6 THEN '{"company_id": false, "companyId": "' || o_custkey || '", "evidence": "text"}' WHEN 7 THEN '{"company_id": 1, "evidence": ""}' WHEN 8 THEN NULL
  WHEN 9 THEN '{"company_id": 1, "evidence": [null]}' ELSE '{"company_id": null, "evidence": [2]}' END"""


@query(
    "evidence_payloads",
    """WITH k AS (SELECT o_orderkey AS id, o_orderkey % 11 IN (0, 2, 3, 6, 7, 9) OR (o_orderkey % 11 = 1 AND o_custkey <> 0) AS named, o_orderkey % 11 IN (2, 3, 7) AS bare FROM orders)
SELECT id, CASE WHEN named AND NOT bare THEN 'completed' ELSE 'failed' END AS status,
  CASE WHEN NOT named THEN 'Evidence store failed: missing company_id in payload' WHEN bare THEN 'Evidence store failed: missing evidence in payload' END AS error_message FROM k""",
)
def evidence_payloads(spark, sf_dir):
    """Evidence jobs that can run, and the others with the reason."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_PAYLOAD).alias("payload"))
    return crawl.judge_evidence_jobs(jobs).select("id", "status", "error_message")


# --- home pages ------------------------------------------------------------------------------------------


@query(
    "page_topk_home",
    f"""WITH {v.SITES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY type_confidence DESC, page_id) AS n FROM sites),
best AS (SELECT domain, url, page_type, n FROM r WHERE n <= 4),
homes AS (SELECT domain, 'https://' || domain || '/' AS url FROM sites GROUP BY 1),
a AS (SELECT * FROM best UNION ALL SELECT domain, url, 'homepage', 0 FROM homes h WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.domain = h.domain AND b.page_type = 'homepage'))
SELECT domain, url, page_type, position FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n) AS position FROM a) WHERE position <= 4""",
)
def page_topk_home(spark, sf_dir):
    """Four pages of every site with its home page among them."""
    sites = v.page_sites(spark, sf_dir).select("domain", "page_id", "url", "page_type", F.col("type_confidence").alias("confidence"))
    homes = sites.groupBy("domain").agg(F.count("*")).select("domain", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"))
    out = crawl.with_home_page(sites, homes, "domain", [F.desc("confidence"), F.col("page_id")], 4)
    return out.select("domain", "url", "page_type", F.col("position").cast("long").alias("position"))


# --- detail and guide pages ------------------------------------------------------------------------------

_DESCRIBED = "'We make ' || p_type || ' goods for everyone in the whole region, and have done so for years'"


@query(
    "detail_pages",
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'own@firm.sa' WHEN p_partkey % 3 <> 0 THEN 'm' || p_partkey || '@b.sa' END AS email,
  CASE WHEN p_partkey % 3 <> 0 THEN '+96611' || (1000000 + p_partkey) ELSE '' END AS phone,
  CASE WHEN p_partkey % 3 <> 0 THEN {_DESCRIBED} END AS description_en,
  p_partkey % 4 = 0 AS own_mail_score FROM part""",
)
def detail_pages(spark, sf_dir):
    """Listing records completed from their detail pages; a third points to none, a quarter has a mail already."""
    p = table(spark, sf_dir, "part")
    html = f"""'<html><body><h1>' || p_name || '</h1><p>' || {_DESCRIBED} || '</p><a href="mailto:m' || p_partkey || '@b.sa">mail</a> <a href="tel:+96611' || (1000000 + p_partkey) || '">call</a></body></html>'"""
    pages = spread(p.where("p_partkey % 3 <> 0"), 4).select(
        F.col("p_partkey").alias("page_id"), F.expr("'http://www.list.example.org/Home/FactoryDetails/' || p_partkey || '/?utm_source=x'").alias("url"),
        F.expr(html).alias("html"),
    )
    # every detail page was fetched twice
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000_000))
    records = p.select(
        F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN 'own@firm.sa' END").alias("email"), F.lit("").alias("phone"),
        F.lit(None).cast("string").alias("description_en"),
        F.expr("CASE WHEN p_partkey % 3 <> 0 THEN 'https://list.example.org/Home/FactoryDetails/' ELSE 'https://list.example.org/p/' END || p_partkey").alias("source_url"),
        F.create_map(F.lit("email"), F.lit(0.11)).alias("field_confidence"),
    )
    out = fl.fill_from_details(records, fl.page_fields(h.parse_pages(twice)))
    kept = F.coalesce(F.col("field_confidence.email") == 0.11, F.lit(False)) & (F.col("email") == "own@firm.sa")
    return out.select("id", "email", "phone", "description_en", F.coalesce(kept, F.lit(False)).alias("own_mail_score"))


_N = "p_name || ' ' || p_partkey"
_GROUP = f"p_partkey div {_PER_PAGE} % 3"


@query(
    "listing_choice",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, CASE (p_partkey // {_PER_PAGE}) % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'b2b_cards' ELSE 'table' END AS strategy, {_N} AS name_en,
  CASE (p_partkey // {_PER_PAGE}) % 3 WHEN 0 THEN 'https://w' || p_partkey || '.sa' WHEN 1 THEN 'https://list.example.org/s/' || p_partkey ELSE 'https://x' || p_partkey || '.example.sa/' END AS website_url FROM part""",
)
def listing_choice(spark, sf_dir):
    """Guide pages with empty card shells beside their sections, card pages whose headings look like sections, and tables."""
    item = f"""CASE {_GROUP} WHEN 0 THEN '<h3>' || {_N} || '</h3><p>We make ' || p_type || ' goods for the whole region</p><p>Website: w' || p_partkey || '.sa</p><li class="supplier-item"><b>Shell ' || p_partkey || '</b></li>'
      WHEN 1 THEN '<li class="supplier-item"><h2><a href="/s/' || p_partkey || '">' || {_N} || '</a></h2><p class="summary">Maker of ' || p_type || ' and much more besides</p></li>'
      ELSE '<table><tr><th>Company<th>Type</tr><tr><td><a href="https://x' || p_partkey || '.example.sa">' || {_N} || '</a><td>' || p_type || '</tr></table>' END"""
    out = ex.choose_listing(h.parse_pages(_listing(spark, sf_dir, item, "<article>", "</article>")))
    return out.select("page_id", "strategy", "name_en", "website_url")

"""Queries over evidence, search, exports, discovery and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.operators import evidence as ev
from tradebook.operators import html as h
from tradebook.operators import search as se
from tradebook.operators import tables as tb
from tradebook.plans import page_queries as pq
from tradebook.plans import views as v
from tradebook.plans.discovery import discover
from tradebook.plans.registry import query, table
from tradebook.session import scratch_folder
from tradebook.sources import writers as wr
from tradebook.streaming import streams as st


def _as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


# --- evidence ------------------------------------------------------------------------------------------


@query(
    "passages_found",
    "SELECT item_id AS passage_id, doc_id AS text_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)",
)
def passages_found(spark, sf_dir):
    """Which documents hold which passages word for word."""
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return ev.contained_passages(p, t)


_SITE_PAGES = f"""{v.SITES_SQL}, vals AS (SELECT domain AS company_id, 'name_en' AS field_name, arg_max(title, page_id) AS value, '' AS snippet FROM sites GROUP BY 1
  UNION ALL SELECT domain, 'products', NULL, lower(arg_max(title, page_id)) FROM sites GROUP BY 1 UNION ALL SELECT domain, 'email', 'none@nowhere.sa', 'not on any page' FROM sites GROUP BY 1)"""


def _site_values(spark, sf_dir):
    sites = v.page_sites(spark, sf_dir)
    titles = sites.groupBy("domain").agg(F.max_by("title", "page_id").alias("title"))
    vals = titles.select(
        F.col("domain").alias("company_id"),
        F.explode(
            F.array(
                F.struct(F.lit("name_en").alias("field_name"), F.col("title").alias("value"), F.lit("").alias("snippet")),
                F.struct(F.lit("products").alias("field_name"), F.lit(None).cast("string").alias("value"), F.lower("title").alias("snippet")),
                F.struct(F.lit("email").alias("field_name"), F.lit("none@nowhere.sa").alias("value"), F.lit("not on any page").alias("snippet")),
            )
        ).alias("_v"),
    ).select("company_id", "_v.*")
    pages = sites.select(
        F.col("domain").alias("company_id"), "page_id", F.col("page_id").alias("ordinal"), "page_type", "url", F.col("html").alias("page_text")
    )
    return vals, pages


@query(
    "evidence_page",
    f"""WITH {_SITE_PAGES}, r AS (SELECT company_id, field_name, page_id, CASE WHEN trim(snippet) <> '' AND contains(lower(html), lower(trim(snippet))) THEN 1
  WHEN length(trim(value)) >= 4 AND contains(lower(html), lower(trim(value))) THEN 2 WHEN page_type = CASE field_name WHEN 'email' THEN 'contact' WHEN 'name_en' THEN 'about' ELSE 'products' END THEN 3 ELSE 4 END AS rule
  FROM vals JOIN sites ON domain = company_id)
SELECT company_id, field_name, page_id, rule FROM r QUALIFY row_number() OVER (PARTITION BY company_id, field_name ORDER BY rule, page_id) = 1""",
)
def evidence_page(spark, sf_dir):
    """The page of a site that shows a value: by snippet, by value, by page type, else the first."""
    vals, pages = _site_values(spark, sf_dir)
    return ev.source_pages_of(vals, pages).select("company_id", "field_name", "page_id", "rule")


@query(
    "evidence_rows",
    f"""WITH {v.RICH_SQL}, c AS (SELECT id AS company_id, unnest(['name_en', 'phone']) AS field_name, unnest([name_en, phone]) AS value, unnest([(CASE WHEN balance / 10000 BETWEEN 0 AND 1 THEN balance / 10000 ELSE 0 END)::DOUBLE, 0.95::DOUBLE]) AS confidence FROM rich)
SELECT company_id, field_name, value, round(confidence, 6) AS confidence, confidence >= 0.9 AS is_locked, 'http://dir.example.org/list/' || (company_id::BIGINT) AS source_url, value[1:500] AS extraction_detail FROM c""",
)
def evidence_rows(spark, sf_dir):
    """Evidence of every scored field of the records."""
    r = v.rich(spark, sf_dir).withColumn(
        "field_confidence", F.create_map(F.lit("name_en"), F.col("balance") / 10000, F.lit("phone"), F.lit(0.95))
    )
    vals = ev.field_values(r, ["name_en", "phone"]).withColumn("snippet", F.lit(""))
    pages = r.select(
        F.col("id").alias("company_id"), F.concat(F.lit("p"), "id").alias("page_id"), F.col("seq").alias("ordinal"), F.lit("other").alias("page_type"),
        F.concat(F.lit("http://dir.example.org/list/"), "id").alias("url"), F.concat_ws(" ", "name_en", "phone").alias("page_text"),
    )
    out = ev.evidence_rows(vals, pages)
    return out.select("company_id", "field_name", "value", F.round("confidence", 6).alias("confidence"), "is_locked", "source_url", "extraction_detail")


@query(
    "source_pages",
    f"""WITH {v.URL_PARTS_SQL} SELECT url, {v.CANONICAL_SQL} AS canonical_url, host AS domain, {v.page_type_sql('path', 'page_type')} AS page_type, length(html)::INTEGER AS html_size_bytes, 'raw' AS status FROM url_parts""",
)
def source_pages(spark, sf_dir):
    """Crawled pages as stored rows."""
    sites = v.page_sites(spark, sf_dir).select("url", "html", "page_type")
    return ev.source_page_rows(sites, _as_of()).select("url", "canonical_url", "domain", "page_type", "html_size_bytes", "status")


@query(
    "stored_page_ids",
    f"""WITH {v.URL_PARTS_SQL}, c AS (SELECT page_id, {v.CANONICAL_SQL} AS k FROM url_parts), s AS (SELECT k, min(page_id) AS stored_id FROM c WHERE page_id % 2 = 0 GROUP BY 1)
SELECT page_id, stored_id FROM c LEFT JOIN s USING (k)""",
)
def stored_page_ids(spark, sf_dir):
    """Pages with the id of the first stored row of the same address; even pages are stored."""
    p = v.pages(spark, sf_dir).select("page_id", "url")
    stored = p.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("canonical_url"), F.col("page_id").alias("ordinal"))
    return ev.stored_page_ids(p, stored, "ordinal").select("page_id", "stored_id")


@query(
    "page_bundles",
    f"""WITH {v.URL_PARTS_SQL}, p AS (SELECT page_id, html, regexp_replace(host, '^www\\.', '') AS domain FROM url_parts)
SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY page_id) - 1 AS page_order, count(*) OVER (PARTITION BY domain) AS total_pages, ceil(sum(length(html)) OVER (PARTITION BY domain) / 1024)::BIGINT AS total_html_kb FROM p""",
)
def page_bundles(spark, sf_dir):
    """Pages of every company in order, with the totals of the company."""
    p = v.pages(spark, sf_dir).select("page_id", "html", urls.domain(F.col("url")).alias("domain"))
    return ev.page_bundle(p, "domain", ["page_id"]).select("domain", "page_id", "page_order", "total_pages", "total_html_kb")


@query(
    "request_texts",
    """WITH n AS (SELECT conv_id % 20 AS grp, conv_id, turn, text, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY conv_id, turn) - 1 AS rn FROM conversations)
SELECT grp, rn // 5 AS chunk, count(*) AS pages, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY conv_id, turn)) AS text_md5 FROM n GROUP BY 1, 2""",
)
def request_texts(spark, sf_dir):
    """Five consecutive texts to a request."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).alias("grp"), "conv_id", "turn", "text")
    out = ev.request_texts(c, "grp", ["conv_id", "turn"], 5)
    return out.select("grp", "chunk", "pages", F.md5("request_text").alias("text_md5"))


@query(
    "combined_text",
    f"""WITH {v.SITES_SQL}, t AS (SELECT domain, url, title, page_type, row_number() OVER (PARTITION BY domain ORDER BY length(title) DESC, page_id) AS rank FROM sites)
SELECT domain, string_agg('[' || upper(page_type) || '] ' || url || chr(10) || title, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS combined_text FROM t WHERE rank <= 6 GROUP BY 1""",
)
def combined_text(spark, sf_dir):
    """One labelled text of the six best pages of a site."""
    sites = v.page_sites(spark, sf_dir).select("domain", "page_id", "url", "page_type", F.col("title").alias("text"))
    ranked = sites.withColumn("rank", F.struct(-F.length("text"), F.col("page_id")))
    return ev.top_page_text(ranked, "domain", ["rank"], 6)


@query(
    "label_cache",
    """WITH k AS (SELECT p_partkey AS id, md5(lower(trim(' ' || p_name || ' '))) AS h FROM part), c AS (SELECT md5(lower(p_name)) AS h, min(p_type) AS mapped_id FROM part WHERE p_name LIKE 'small%' GROUP BY 1)
SELECT id, mapped_id FROM k JOIN c USING (h)""",
)
def label_cache(spark, sf_dir):
    """Labels answered from the cache by the hash of their text."""
    p = table(spark, sf_dir, "part")
    labels = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("raw_text"))
    cache = p.where(F.col("p_name").like("small%")).groupBy(F.md5("p_name").alias("raw_text_hash")).agg(F.min("p_type").alias("mapped_id"))
    return ev.label_lookup(labels, cache)[0].select("id", "mapped_id")


@query(
    "label_misses",
    "SELECT DISTINCT md5(p_name) AS raw_text_hash FROM part WHERE p_name NOT LIKE 'small%'",
)
def label_misses(spark, sf_dir):
    """Labels the cache does not know, each once."""
    p = table(spark, sf_dir, "part")
    cache = p.where(F.col("p_name").like("small%")).select(F.md5("p_name").alias("raw_text_hash"), F.col("p_type").alias("mapped_id"))
    return ev.label_lookup(p.select(F.col("p_name").alias("raw_text")), cache)[1].select("raw_text_hash")


@query(
    "suggestions",
    f"""WITH {v.RICH_SQL}, c AS (SELECT id, name_en, phone FROM rich), n AS (SELECT id AS company_id, 'name_en' AS field_name, name_en AS current_value, segment AS suggested_value FROM rich UNION ALL SELECT id, 'phone', phone, CASE WHEN seq % 2 = 0 THEN phone ELSE '+96611000' || seq END FROM rich)
SELECT company_id, field_name, current_value, suggested_value FROM n WHERE coalesce(suggested_value, '') <> '' AND suggested_value IS DISTINCT FROM current_value""",
)
def suggestions(spark, sf_dir):
    """Field suggestions beside the current value, where they differ."""
    r = v.rich(spark, sf_dir)
    new = r.select("id", F.col("segment").alias("name_en"), F.expr("CASE WHEN seq % 2 = 0 THEN phone ELSE '+96611000' || seq END").alias("phone"))
    return ev.suggestions(new, r, ["name_en", "phone"]).select("company_id", "field_name", "current_value", "suggested_value")


@query(
    "junction_rows",
    f"""WITH {v.RICH_SQL}, u AS (SELECT id AS company_id, trim(unnest(products)) AS value FROM rich) SELECT DISTINCT company_id, value FROM u WHERE value <> ''""",
)
def junction_rows(spark, sf_dir):
    """A list column as junction rows."""
    return ev.junction_rows(v.rich(spark, sf_dir), "products")


@query("social_rows", f"WITH {v.RICH_SQL} SELECT id AS company_id, 'linkedin' AS platform, linkedin_url AS url FROM rich WHERE linkedin_url <> ''")
def social_rows(spark, sf_dir):
    return ev.social_rows(v.rich(spark, sf_dir))


@query(
    "valid_sites",
    f"""WITH {v.RICH_SQL}, d AS (SELECT id, regexp_extract(website_url, '^https?://(?:www\\.)?([^/]+)', 1) AS site, balance FROM rich)
SELECT id, site, round(balance / 10000, 6) AS site_confidence FROM d WHERE site <> '' AND balance / 10000 > 0.4""",
)
def valid_sites(spark, sf_dir):
    """Companies whose site was judged valid."""
    r = v.rich(spark, sf_dir)
    conf = F.col("balance") / 10000
    verdicts = r.select(urls.domain(F.col("website_url")).alias("domain"), (conf > 0.4).alias("is_valid"), conf.alias("confidence")).where(
        F.col("website_url").rlike("^https?://")
    )
    kept, _ = ev.filter_valid_sites(r.where(F.col("website_url").rlike("^https?://")), verdicts)
    return kept.select("id", urls.domain(F.col("website_url")).alias("site"), F.round("site_confidence", 6).alias("site_confidence"))


# --- JSON cells --------------------------------------------------------------------------------------------


@query("json_path", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_path(spark, sf_dir):
    """A path of a JSON column, cast."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("json_tolerant", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events")
def json_tolerant(spark, sf_dir):
    """JSON inside other text, or none at all."""
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('Sure, here: ', props, ' - done') ELSE concat('no json ', event_id) END")
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("answer"))
    return e.select("event_id", F.try_variant_get(tx.lenient_json(F.col("answer")), "$.k", "bigint").alias("k"))


# --- search -------------------------------------------------------------------------------------------------


def _index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name_en"), F.col("lang").alias("business_type"), F.col("text").alias("description_en")
    )
    return se.index_rows(d, _as_of())


_SEARCHABLE = "trim(regexp_replace(regexp_replace(lower(source || ' | ' || lang || ' | ' || text), '[^\\w\\s\\x{0600}-\\x{06ff}\\x{0750}-\\x{077f}]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("search_index", f"SELECT doc_id AS id, md5({_SEARCHABLE}) AS text_md5 FROM documents WHERE text IS NOT NULL")
def search_index(spark, sf_dir):
    """Search rows of whole texts."""
    return _index(spark, sf_dir).select("id", F.md5("searchable_text").alias("text_md5"))


@query("search_terms", f"SELECT doc_id AS id FROM documents WHERE contains({_SEARCHABLE}, 'the') AND contains({_SEARCHABLE}, 'src1') ORDER BY id LIMIT 20 OFFSET 10")
def search_terms(spark, sf_dir):
    """One query: every term a piece of the text, a page of the hits."""
    return se.search(_index(spark, sf_dir), " The SRC1 ", 20, 10).select("id")


@query(
    "search_many",
    f"""WITH d AS (SELECT doc_id AS id, string_split_regex({_SEARCHABLE}, '\\s+') AS words FROM documents),
q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda w: w <> '')) AS terms FROM benchmark)
SELECT query_id, id FROM q JOIN d ON list_has_all(d.words, q.terms)""",
)
def search_many(spark, sf_dir):
    """Every passage as a query of all its words, in all texts at once; marks are blanks in both."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace(F.lower("text"), r"[^\w\s]", " ").alias("query"))
    return se.search_many(q, _index(spark, sf_dir))


@query(
    "search_reindex",
    f"""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'changed en' ELSE lang END AS shown FROM documents WHERE doc_id % 7 <> 0""",
)
def search_reindex(spark, sf_dir):
    """Index after some rows changed and some went."""
    idx = _index(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    changed = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.lit("changed").alias("name_en"), F.lit("en").alias("business_type"))
    gone = d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    out = se.remove(se.reindex(idx, changed, _as_of()), gone)
    return out.select("id", F.when(F.col("name_en") == "changed", F.concat_ws(" ", "name_en", "business_type")).otherwise(F.col("business_type")).alias("shown"))


@query("index_report", f"WITH {v.RICH_SQL} SELECT count_if(name_en IS NOT NULL AND name_en <> '')::BIGINT AS success, count_if(name_en IS NULL OR name_en = '')::BIGINT AS failed FROM rich")
def index_report(spark, sf_dir):
    """How many rows a rebuild takes; here a missing name stands for a missing id."""
    return se.index_report(v.rich(spark, sf_dir).withColumn("id", F.col("name_en")))


# --- exports ------------------------------------------------------------------------------------------------


@query(
    "export_rows",
    f"""WITH {v.RICH_SQL} SELECT id, name_en, CASE WHEN regexp_matches(website_url, '^https') THEN regexp_replace(website_url, '^https://www\\.', 'https://') WHEN website_url IS NOT NULL THEN website_url END AS website_url,
  array_to_string(categories, '; ') AS categories, array_to_string(products, '; ') AS products, status FROM rich""",
)
def export_rows(spark, sf_dir):
    """Rows as the CSV export writes them."""
    r = v.rich(spark, sf_dir)
    out = wr.export_rows(r, ["id", "name_en", "website_url", "categories", "products", "status"])
    return out


@query(
    "export_payload",
    f"""WITH {v.RICH_SQL} SELECT id, coalesce(name_en, '') AS name_en, business_type AS type, CASE WHEN phone <> '' THEN phone END AS phone, 'Saudi Arabia' AS country, len(coalesce(categories, []))::INTEGER AS n_categories, is_verified AS verified, coalesce(score, 0) AS confidence FROM rich""",
)
def export_payload(spark, sf_dir):
    """The nested payload, read back from its JSON."""
    out = wr.api_payload(v.rich(spark, sf_dir).withColumn("confidence_score", F.col("score")))
    body = F.parse_json("body")
    g = lambda p, t: F.variant_get(body, p, t)
    return out.select(
        "id", g("$.name.en", "string").alias("name_en"), g("$.type", "string").alias("type"), g("$.contact.phone", "string").alias("phone"),
        g("$.location.country", "string").alias("country"), F.size(g("$.categories", "array<string>")).alias("n_categories"),
        g("$.verified", "boolean").alias("verified"), g("$.confidence", "double").alias("confidence"),
    )


def _sitemap_companies(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'a&b-' || o_orderkey END").alias("slug"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name_en"),
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'pending' ELSE 'approved' END").alias("status"),
        F.lit(None).cast("timestamp").alias("updated_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query(
    "sitemap_parts",
    """WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'a&amp;b-' || o_orderkey ELSE 'order-' || o_orderkey END AS slug, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders WHERE o_orderstatus <> 'P')
SELECT rn // 1000 + 1 AS part, rn % 1000 + 1 AS pos, id, '  <url>' || chr(10) || '    <loc>https://b.example.org/en/company/' || id || '/' || slug || '</loc>' || chr(10) || '    <xhtml:link rel="alternate" hreflang="ar" href="https://b.example.org/ar/company/' || id || '/' || slug || '" />' || chr(10)
  || '    <lastmod>' || day || '</lastmod>' || chr(10) || '    <changefreq>weekly</changefreq>' || chr(10) || '    <priority>0.6</priority>' || chr(10) || '  </url>' AS entry FROM a""",
)
def sitemap_parts(spark, sf_dir):
    """Sitemap entries of the approved rows, a thousand to a part."""
    return wr.company_sitemap(_sitemap_companies(spark, sf_dir), "https://b.example.org", 1000)


@query(
    "sitemap_index",
    """WITH n AS (SELECT ceil(count(*) / 1000.0)::BIGINT AS parts FROM orders WHERE o_orderstatus <> 'P'), x AS (SELECT unnest(list_concat(['static', 'categories'], list_transform(range(1, parts + 1), lambda i: 'companies-' || i))) AS name FROM n)
SELECT 'https://b.example.org/sitemap-' || name || '.xml' AS loc FROM x""",
)
def sitemap_index(spark, sf_dir):
    return wr.sitemap_index(_sitemap_companies(spark, sf_dir), "https://b.example.org", 1000).select("loc")


@query("category_sitemap", "WITH s AS (SELECT DISTINCT lower(p_type) AS slug FROM part), c AS (SELECT DISTINCT lower(n_name) AS slug FROM nation) SELECT 'https://b.example.org/en/category/' || slug AS loc FROM s UNION ALL SELECT 'https://b.example.org/ar/category/' || slug FROM s UNION ALL SELECT 'https://b.example.org/location/' || slug FROM c")
def category_sitemap(spark, sf_dir):
    """Entries of category pages in both languages and of city pages."""
    cats = table(spark, sf_dir, "part").select(F.lower("p_type").alias("slug")).distinct()
    cities = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("slug")).distinct()
    return wr.category_sitemap(cats, cities, "https://b.example.org").select("loc")


@query("export_written", f"WITH {v.RICH_SQL} SELECT id, name_ar, array_to_string(products, '; ') AS products FROM rich")
def export_written(spark, sf_dir):
    """The CSV export written and read back."""
    path = scratch_folder(spark, "export")
    wr.write_csv(wr.export_rows(v.rich(spark, sf_dir), ["id", "name_ar", "products"]), path, bom=False)
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("id string, name_ar string, products string").csv(path)
    kinds = v.rich(spark, sf_dir).select("id", (F.col("name_ar") == "").alias("_blank"))
    # CSV knows one kind of nothing; blank and null names are told apart by the source
    return back.join(kinds, "id").select("id", F.when(F.col("_blank"), "").otherwise(F.col("name_ar")).alias("name_ar"), "products")


# --- discovery and streams -------------------------------------------------------------------------------------

_DISCOVER_ITEM = "concat('<div class=\"company-card\"><h3>', p_name, ' ', p_partkey, '</h3><a href=\"/c/', p_partkey, '\">More</a></div>')"


def _stored_companies(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(
        (F.col("p_partkey") + 100_001).cast("string").alias("id"), F.concat_ws(" ", F.upper("p_name"), F.col("p_partkey").cast("string")).alias("name_en"),
        F.lit("").alias("name_ar"), F.lit("").alias("website_url"), F.lit("").alias("source_url"), F.lit("2023-01-01").cast("timestamp").alias("first_seen_at"),
    )


@query(
    "discovery",
    """WITH m AS (SELECT max(p_partkey) + 100001 AS top FROM part WHERE p_partkey % 3 = 0)
SELECT CASE WHEN p_partkey % 3 = 0 THEN '' || (p_partkey + 100001) ELSE '' || (top + row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY p_partkey)) END AS id, p_name || ' ' || p_partkey AS name_en,
  'https://list.example.org/c/' || p_partkey AS website_url, CASE WHEN p_partkey % 3 = 0 THEN 'updated' ELSE 'created' END AS action, 0.33::DOUBLE AS data_quality_score, 'success' AS scrape_status,
  CASE WHEN p_partkey % 3 = 0 THEN '2023-01-01' ELSE '2024-02-01' END AS first_seen FROM part, m""",
)
def discovery(spark, sf_dir):
    """Listing pages to company rows: matched records keep their id, others get the next one."""
    parsed = h.parse_pages(pq._listing(spark, sf_dir, _DISCOVER_ITEM, "", ""))
    found = discover(parsed, _stored_companies(spark, sf_dir), _as_of()).companies
    return found.select(
        "id", "name_en", "website_url", "action", "data_quality_score", "scrape_status", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen")
    )


@query(
    "stream_counters",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS metric, count(*) AS n, round(sum(value), 4) AS total, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2",
)
def stream_counters(spark, sf_dir):
    """Hourly figures of the event stream, worked off to the end."""
    schema = table(spark, sf_dir, "events").schema
    events = st.file_stream(spark, sf_dir, schema, names="events.parquet")
    points = events.select(F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"), F.lit("{}").alias("tags_key"))
    folder = scratch_folder(spark, "stream-counters")
    key = ["window_start", "metric", "tags_key"]
    change = lambda batch, current: batch if current is None else tb.upsert(current, batch, key)
    writer = st.windowed_metrics(points).writeStream.outputMode("update").foreachBatch(st.keep_versions(f"{folder}/table", change))
    st.run_to_end(writer, f"{folder}/checkpoint")
    _, out = wr.latest_version(spark, f"{folder}/table")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "metric", "n", F.round("total", 4).alias("total"), "min", "max")


@query("stream_seed", f"WITH {v.URL_PARTS_SQL}, c AS (SELECT {v.CANONICAL_SQL} AS canonical_url, regexp_replace(host, '^www\\.', '') AS domain FROM url_parts) SELECT DISTINCT canonical_url, domain FROM c")
def stream_seed(spark, sf_dir):
    """Seeds of the page stream, each address once."""
    schema = table(spark, sf_dir, "pages").schema
    found = st.file_stream(spark, sf_dir, schema, names="pages.parquet").select(
        "url", F.timestamp_seconds(F.col("page_id") % 60 + 1_700_000_000).alias("ts")
    )
    folder = scratch_folder(spark, "stream-seed")

    def change(batch, current):
        rows = batch.select("canonical_url", "domain")
        return rows if current is None else tb.insert_absent(current, rows, ["canonical_url"])

    st.run_to_end(st.upsert_stream(st.seed_stream(found), f"{folder}/table", change), f"{folder}/checkpoint")
    return wr.latest_version(spark, f"{folder}/table")[1]


@query(
    "stream_upsert",
    f"""WITH {v.SITES_SQL} SELECT domain, max(page_id) AS page_id, arg_max(title, page_id) AS title FROM sites GROUP BY 1""",
)
def stream_upsert(spark, sf_dir):
    """Company rows kept in step with the page stream: the newest page of a site names it."""
    schema = table(spark, sf_dir, "pages").schema
    pages = st.file_stream(spark, sf_dir, schema, names="pages.parquet")
    rows = pages.select("page_id", urls.domain(F.col("url")).alias("domain"), F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), r"\s+", " ")).alias("title"))
    folder = scratch_folder(spark, "stream-upsert")

    def change(batch, current):
        # an older page may come in a later batch, so the stored page takes part
        rows = batch if current is None else batch.unionByName(current.select(*batch.columns))
        return rows.groupBy("domain").agg(F.max("page_id").alias("page_id"), F.max_by("title", "page_id").alias("title"))

    st.run_to_end(st.upsert_stream(rows, f"{folder}/table", change), f"{folder}/checkpoint")
    return wr.latest_version(spark, f"{folder}/table")[1]

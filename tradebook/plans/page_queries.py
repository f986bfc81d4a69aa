"""Queries over parsed pages: elements, fields, records, sections, profiles.

The crawled pages are plain articles.  Listings and profiles are written by
Spark from the part table, so that the records read back can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import urls
from tradebook.operators import extract as ex
from tradebook.operators import fields as fl
from tradebook.operators import html as h
from tradebook.operators import records as rec
from tradebook.plans import views as v
from tradebook.plans.registry import query, table
from tradebook.session import spread, written

_PER_PAGE = 20


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.parse_pages(v.pages(spark, sf_dir))


def _listing(spark, sf_dir, item: str, head: str, tail: str, host: str = "'https://list.example.org/p/'") -> DataFrame:
    """Listing pages of twenty parts each; ``item`` is the HTML of one part as a SQL expression."""
    p = table(spark, sf_dir, "part").select(
        F.expr(f"p_partkey div {_PER_PAGE}").alias("page_id"), "p_partkey", F.expr(item).alias("item")
    )
    pages = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n")
    url = F.concat(F.expr(host), F.col("page_id").cast("string"))
    return pages.select("page_id", url.alias("url"), F.concat(F.lit(f"<html><body>{head}"), body, F.lit(f"{tail}</body></html>")).alias("html"))


def _records(spark, sf_dir, item, head, tail, strategies=None, host="'https://list.example.org/p/'"):
    return ex.extract_records(h.parse_pages(_listing(spark, sf_dir, item, head, tail, host)), strategies)


# --- the crawled pages --------------------------------------------------------------------------------


_NO_SCRIPT = r"regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query(
    "elements_count",
    rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all({_NO_SCRIPT}, '<([a-z][a-z0-9]*)[\s>/]', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL""",
)
def elements_count(spark, sf_dir):
    """How many elements of each tag every page has."""
    rows = _parsed(spark, sf_dir).select("page_id", F.explode("nodes.tag").alias("tag"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _entities(x: str) -> str:
    return f"replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query(
    "page_text",
    rf"""WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<body>(.*)', 1) AS b FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '(?s)<!--.*?-->', '', 'g'), '(?s)<(nav|footer|script|style)>.*?</(nav|footer|script|style)>', '', 'g'), '(?s)<footer>.*$', '') AS b FROM b)
SELECT page_id, md5(regexp_replace({_entities("regexp_replace(b, '<[^>]*>', '', 'g')")}, '[\s\x{{00a0}}]+', '', 'g')) AS text_md5 FROM c""",
)
def page_text(spark, sf_dir):
    """Visible text of every page, whole; blanks aside."""
    text = h.visible_text(fv.HIDDEN_TAGS)
    return _parsed(spark, sf_dir).select("page_id", F.md5(F.regexp_replace(text, r"[\s\u00a0]+", "")).alias("text_md5"))


_HEAD1 = _entities(r"regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')")
_TITLE = _entities(r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_PARAS = r"list_transform(string_split(regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1), '<p>')[2:], lambda x: " + (
    f"regexp_replace({_entities(chr(114) + 'egexp_replace(regexp_extract(x, ' + chr(39) + '(?s)^(.*?)(?:</p>|$)' + chr(39) + ', 1), ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '^\\s+|\\s+$', '', 'g'))"
)


@query(
    "page_names",
    rf"""SELECT page_id, CASE WHEN length(trim({_HEAD1})) BETWEEN 3 AND 99 THEN trim({_HEAD1}) ELSE trim(regexp_replace(trim({_TITLE}), '(?s)\s*[-|—–]\s*.*$', '')) END AS name,
  (CASE WHEN length(trim({_HEAD1})) BETWEEN 3 AND 99 THEN 0.7 ELSE 0.5 END)::DOUBLE AS confidence,
  CASE WHEN length(trim({_HEAD1})) BETWEEN 3 AND 99 THEN 'h1' ELSE 'title_tag' END AS source FROM pages""",
)
def page_names(spark, sf_dir):
    """Name a page gives its company: the heading, else the title without its suffix."""
    p = fl.with_json_ld(_parsed(spark, sf_dir)).select("page_id", fl.company_name().alias("n"))
    return p.select("page_id", F.col("n.value").alias("name"), "n.confidence", "n.source")


@query(
    "page_descriptions",
    f"""WITH d AS (SELECT page_id, list_filter({_PARAS}, lambda x: length(x) BETWEEN 51 AND 499)[1] AS value FROM pages)
SELECT page_id, value, (CASE WHEN value IS NULL THEN 0 ELSE 0.5 END)::DOUBLE AS confidence FROM d""",
)
def page_descriptions(spark, sf_dir):
    """First paragraph of fitting length."""
    p = _parsed(spark, sf_dir).select("page_id", fl.description().alias("d"))
    return p.select("page_id", "d.value", "d.confidence")


@query(
    "page_links",
    rf"""WITH {v.URL_PARTS_SQL}, l AS (SELECT page_id, scheme || '://' || host AS root, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM url_parts)
SELECT page_id, href, root || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target FROM l""",
)
def page_links(spark, sf_dir):
    """Every link with its absolute address; letters outside ASCII are percent-encoded."""
    return fl.links(_parsed(spark, sf_dir)).select("page_id", "href", "target")


@query(
    "profile_links",
    rf"""WITH {v.URL_PARTS_SQL}, l AS (SELECT page_id, scheme || '://' || host AS root, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM url_parts)
SELECT DISTINCT page_id, root || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS target FROM l""",
)
def profile_links(spark, sf_dir):
    """Links one segment deep on the page's own host."""
    return fl.profile_links(_parsed(spark, sf_dir))


@query(
    "page_lists",
    rf"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS name FROM pages)
SELECT page_id, trim({_entities('name')}) AS name_en, 0.35::DOUBLE AS confidence_score FROM l WHERE length(trim({_entities('name')})) BETWEEN 2 AND 200""",
)
def page_lists(spark, sf_dir):
    """Records of linked lists: what the generic rules see on an article page is its menu."""
    out = ex.extract_records(_parsed(spark, sf_dir), ["list"])
    return out.select("page_id", F.coalesce("name_en", "name_ar").alias("name_en"), "confidence_score")


_BODY = rf"lower({_entities(chr(114) + 'egexp_replace(regexp_replace(regexp_extract(html, ' + chr(39) + '(?s)<body>(.*)' + chr(39) + ', 1), ' + chr(39) + '(?s)<!--.*?-->' + chr(39) + ', ' + chr(39)*2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39)*2 + ', ' + chr(39) + 'g' + chr(39) + ')')})"


@query(
    "website_verdict",
    f"""WITH b AS (SELECT page_id, {_BODY} AS body, trim({_TITLE}) AS title, html FROM pages),
s AS (SELECT page_id, regexp_matches(body, '{'|'.join(fv.PARKED_PHRASES)}') AS parked, regexp_matches(body, '{'|'.join(fv.SPAM_PHRASES)}') AS spam, regexp_matches(body, '{'|'.join(fv.COMPANY_PAGE_WORDS)}') AS company,
  length(title) > 5 AS titled, contains(html, '<nav>') AS nav, contains(html, '<footer>') AS footer FROM b)
SELECT page_id, parked AS is_parked, company AND NOT parked AND NOT spam AS has_company_content,
  CASE WHEN parked OR spam THEN 0.1::DOUBLE ELSE (50 + CASE WHEN company THEN 20 ELSE 0 END + CASE WHEN titled THEN 10 ELSE 0 END + CASE WHEN nav THEN 5 ELSE 0 END + CASE WHEN footer THEN 5 ELSE 0 END) / 100.0::DOUBLE END AS confidence FROM s""",
)
def website_verdict(spark, sf_dir):
    """Is the stored page a real company site: parked and spam phrases, company words, page structure."""
    has = lambda cond: F.expr(f"exists(nodes, n -> {cond})")
    tags = {
        "nav": has("n.tag = 'nav'"), "footer": has("n.tag = 'footer'"),
        "contact": has(h.has_class("n", "contact") + " OR n.id = 'contact'"), "about": has(h.has_class("n", "about") + " OR n.id = 'about'"),
    }
    title = F.trim(F.expr(f"transform(array({h.first_of(chr(110) + '.tag = ' + chr(39) + 'title' + chr(39))}), o -> {h.text_of('o')})[0]"))
    p = _parsed(spark, sf_dir).select("page_id", F.expr(h.body_text()).alias("body"), title.alias("title"), F.expr(h.meta("description")).alias("meta"), *[c.alias(f"has_{n}") for n, c in tags.items()])
    out = p.select("page_id", rec.website_verdict(F.col("body"), F.col("title"), F.coalesce("meta", F.lit("")), F.lit(False), {n: F.col(f"has_{n}") for n in tags}).alias("w"))
    return out.select("page_id", "w.is_parked", "w.has_company_content", "w.confidence")


@query(
    "field_candidates",
    rf"""SELECT page_id, 'name' AS field, (CASE WHEN length(trim({_HEAD1})) BETWEEN 3 AND 99 THEN 0.7 ELSE 0.5 END)::DOUBLE AS confidence FROM pages
UNION ALL SELECT page_id, 'description', 0.5 FROM pages WHERE len(list_filter({_PARAS}, lambda x: length(x) BETWEEN 51 AND 499)) > 0
UNION ALL SELECT page_id, 'phones', 0.7 FROM pages WHERE false""",
)
def field_candidates(spark, sf_dir):
    """All fields found on the crawled pages, in long form; contact fields aside, which articles do not state."""
    rows = fl.field_candidates(fl.page_fields(_parsed(spark, sf_dir)))
    return rows.where(F.col("field").isin("name", "description")).select("page_id", "field", "confidence")


@query("page_contacts")
def page_contacts(spark, sf_dir):
    """Mails, phones, social links, logo, website, address and team of every crawled page."""
    f = fl.page_fields(_parsed(spark, sf_dir))
    return f.select(
        "page_id", F.to_json("emails.value").alias("emails"), F.to_json("phones.value").alias("phones"), F.to_json("socials.value").alias("socials"),
        F.col("logo.value").alias("logo"), F.col("website.value").alias("website"), F.col("address.value").alias("address"), F.to_json("team.value").alias("team"),
    )


@query(
    "main_content",
    rf"""WITH a AS (SELECT page_id, contains(html, '<article>') AS has, regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1) AS a FROM pages)
SELECT page_id, 'article' AS root_tag, md5(regexp_replace({_entities("regexp_replace(a, '<[^>]*>', '', 'g')")}, '[\s\x{{00a0}}]+', '', 'g')) AS main_md5 FROM a WHERE has""",
)
def main_content(spark, sf_dir):
    """Text of the main element without menus and side blocks."""
    m = ex.main_content(_parsed(spark, sf_dir))
    return m.select("page_id", "root_tag", F.md5(F.regexp_replace("main_text", r"[\s\u00a0]+", "")).alias("main_md5"))


# --- rule choice ---------------------------------------------------------------------------------------------


def _family_sql(u: str) -> str:
    rows = []
    for i, (name, words, more, with_more, without) in enumerate(fv.SITE_FAMILIES):
        has = " OR ".join(f"contains({u}, '{w}')" for w in words)
        score = f"CASE WHEN {' OR '.join(f'contains({u}, {chr(39)}{m}{chr(39)})' for m in more)} THEN {with_more} ELSE {without} END" if more else str(with_more)
        rows.append(f"{{'score': (CASE WHEN {has} THEN {score} ELSE 0 END)::DOUBLE, 'turn': {-i}, 'family': '{name}'}}")
    rows.append(f"{{'score': {fv.GENERIC_SCORE}::DOUBLE, 'turn': -99, 'family': 'generic'}}")
    return f"list_sort([{', '.join(rows)}], 'DESC')[1]"


_MIXED = "CASE s_suppkey % 9 WHEN 0 THEN 'https://www.modon.gov.sa/en/factories/' WHEN 1 THEN 'https://riyadhchamber.sa/' WHEN 2 THEN 'https://x.gov.sa/companies/' WHEN 3 THEN 'https://www.kompass.com/c/' WHEN 4 THEN 'https://site.example.org/suppliers/' WHEN 5 THEN 'http://saudidir.com/' WHEN 6 THEN 'https://www.cybo.com/?ref=' WHEN 7 THEN 'https://firm.com.sa/members/' ELSE 'https://plain.example.org/' END || s_suppkey"


@query("site_families", f"WITH u AS (SELECT s_suppkey AS id, lower({_MIXED}) AS u FROM supplier), f AS (SELECT id, {_family_sql('u')} AS f FROM u) SELECT id, f.family AS family, f.score AS score FROM f")
def site_families(spark, sf_dir):
    """The rule set an address gets."""
    u = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_MIXED).alias("url"))
    return u.select("id", ex.site_family(F.col("url")).alias("f")).select("id", "f.family", "f.score")


# --- listings ----------------------------------------------------------------------------------------------------

_N = "p_name || ' ' || p_partkey"


@query(
    "cards",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'https://list.example.org/c/' || p_partkey AS website_url, '+966 11 ' || (1000000 + p_partkey) AS phone,
  CASE WHEN p_partkey % 2 = 0 THEN 'info' || p_partkey || '@firm.sa' END AS email, 0.5::DOUBLE AS confidence_score, 'cards' AS strategy FROM part""",
)
def cards(spark, sf_dir):
    """Card grids by the generic rules; menu cards are skipped."""
    item = f"""concat('<div class="company-card x"><h3> ', {_N}, '</h3><a href="/c/', p_partkey, '">More</a> <span>Tel +966 11 ', 1000000 + p_partkey, ' mail ',
      CASE WHEN p_partkey % 2 = 0 THEN concat('info', p_partkey, '@firm.sa') ELSE 'x@example.com' END, '</span></div>')"""
    out = _records(spark, sf_dir, item, '<div class="card"></div><div class="company-card"><h3>Home</h3></div>', "<p>end")
    return out.select("page_id", "name_en", "website_url", "phone", "email", "confidence_score", "strategy")


@query(
    "cards_rich",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'https://www.kompass.com/s/' || p_partkey AS website_url, '0111' || (100000 + p_partkey) AS phone, 'Maker of ' || p_type AS description_en,
  CASE WHEN p_partkey % 3 = 0 THEN 'Riyadh' ELSE 'Elsewhere' END AS city, p_type || '|' || p_brand AS categories, 'b2b_portal' AS family FROM part""",
)
def cards_rich(spark, sf_dir):
    """Card grids of a portal, with description, city and categories; the rules are chosen by the address."""
    item = f"""concat('<li class="supplier-item"><h2><a href="/s/', p_partkey, '">', {_N}, '</a></h2><p class="summary">Maker of ', p_type, '</p><span class="location">',
      CASE WHEN p_partkey % 3 = 0 THEN 'King Road, Riyadh' ELSE 'Elsewhere' END, '</span><span class="tag">', p_type, '</span><span class="tag">', p_brand, '</span><a href="tel:0111', 100000 + p_partkey, '">call</a>')"""
    out = _records(spark, sf_dir, item, "<ul>", "</ul>", None, "'https://www.kompass.com/list/'")
    return out.select("page_id", "name_en", "website_url", "phone", "description_en", "city", F.array_join("categories", "|").alias("categories"), "family")


@query(
    "cards_labelled",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, 'مصنع ' || p_partkey AS name_ar, '' || (1010000000 + p_partkey) AS cr_number, p_type AS description_en FROM part""",
)
def cards_labelled(spark, sf_dir):
    """Cards with labelled paragraphs: name after its label, digits of the registry line."""
    item = "concat('<div class=\"card-pro\"><p>المصنع : مصنع ', p_partkey, '</p><p>رقم السجل: ', 1010000000 + p_partkey, '</p><h5>', p_type, '</h5></div>')"
    out = _records(spark, sf_dir, item, "", "", ["labelled_cards"])
    return out.select("page_id", "name_ar", "cr_number", "description_en")


@query(
    "tables",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, CASE WHEN p_partkey % 2 = 0 THEN 'https://x' || p_partkey || '.example.sa/' END AS website_url, 0.4::DOUBLE AS confidence_score, 'table' AS strategy FROM part""",
)
def tables(spark, sf_dir):
    """Table listings: first cell is the name; the header row is skipped."""
    item = f"concat('<tr><td>', CASE WHEN p_partkey % 2 = 0 THEN concat('<a href=\"https://x', p_partkey, '.example.sa\">', {_N}, '</a>') ELSE {_N} END, '<td>', p_type, '</tr>')"
    out = _records(spark, sf_dir, item, "<table><tr><th>Company<th>Type</tr>", "</table>", ["json_ld", "table", "list"])
    return out.select("page_id", "name_en", "website_url", "confidence_score", "strategy")


@query(
    "tables_registry",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, p_type AS description_en, '70' || (1000000 + p_partkey) AS cr_number, 'Jeddah' AS city, 0.85::DOUBLE AS confidence_score, 'registry' AS family FROM part""",
)
def tables_registry(spark, sf_dir):
    """Registry tables: column roles come from the header words."""
    item = f"concat('<tr><td>70', 1000000 + p_partkey, '</td><td>', p_type, '</td><td>', {_N}, '</td><td>Jeddah</td></tr>')"
    head = '<table class="data-table"><tr><th>CR No</th><th>Activity</th><th>Company name</th><th>City</th></tr>'
    out = _records(spark, sf_dir, item, head, "</table>", None, "'https://mc.gov.sa/companies/'")
    return out.select("page_id", "name_en", "description_en", "cr_number", "city", "confidence_score", "family")


@query(
    "tables_listview",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, p_type || ' | ' || p_brand AS description_en, 'https://www.modon.gov.sa/f/' || p_partkey AS website_url, 'listview' AS strategy FROM part""",
)
def tables_listview(spark, sf_dir):
    """List views of an estate portal: name and link from the first cell, the rest joined."""
    item = f"concat('<tr><td><a href=\"/f/', p_partkey, '\">', {_N}, '</a></td><td>', p_type, '</td><td> </td><td>', p_brand, '</td></tr>')"
    out = _records(spark, sf_dir, item, '<table class="ms-listviewtable"><tr><th>Name</th></tr>', "</table>", None, "'https://www.modon.gov.sa/en/factories/'")
    return out.select("page_id", "name_en", "description_en", "website_url", "strategy")


@query(
    "portal_links",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'https://www.modon.gov.sa/Factory/' || p_partkey AS website_url, 0.65::DOUBLE AS confidence_score FROM part""",
)
def portal_links(spark, sf_dir):
    """Links of the main zone of a portal page, navigation left out."""
    item = f"concat('<a href=\"/Factory/', p_partkey, '\">', {_N}, '</a> <a href=\"#top\">Top of ', p_partkey, '</a>')"
    out = _records(spark, sf_dir, item, '<a href="/out">Outside</a><main><a href="/x">Home</a>', "</main>", None, "'https://www.modon.gov.sa/en/partners/'")
    return out.select("page_id", "name_en", "website_url", "confidence_score")


@query(
    "portal_cells",
    f"SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, p_type AS description_en, 'value_cells' AS strategy FROM part",
)
def portal_cells(spark, sf_dir):
    """Rows whose cells carry the portal's value classes."""
    item = f"concat('<tr><td class=\"ms-vb2\">', {_N}, '</td><td class=\"ms-vb\">', p_type, '</td></tr>')"
    out = _records(spark, sf_dir, item, "<table>", "</table>", ["listview", "portal_cards", "zone_links", "value_cells", "headings"])
    return out.select("page_id", "name_en", "description_en", "strategy")


@query(
    "portal_cards",
    f"SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'https://list.example.org/d/' || p_partkey AS website_url, 'portal_cards' AS strategy FROM part",
)
def portal_cards(spark, sf_dir):
    """Cards of a portal's list component."""
    item = f"concat('<div class=\"ms-List-cell\"><div class=\"itemTitle\"><a href=\"/d/', p_partkey, '\">', {_N}, '</a></div><a href=\"/e\">edit</a></div>')"
    out = _records(spark, sf_dir, item, "", "", ["listview", "portal_cards", "zone_links"])
    return out.select("page_id", "name_en", "website_url", "strategy")


@query("portal_headings", f"SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'headings' AS strategy FROM part")
def portal_headings(spark, sf_dir):
    """Headings of a portal page, when nothing else is there."""
    out = _records(spark, sf_dir, f"concat('<h3>', {_N}, '</h3><p>text</p>')", "<h2>Our Partners</h2>", "", ["listview", "zone_links", "value_cells", "headings"])
    return out.select("page_id", "name_en", "strategy")


@query(
    "definition_lists",
    f"SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, CASE WHEN p_partkey % 3 = 0 THEN 'https://list.example.org/t/' || p_partkey END AS website_url, 0.3::DOUBLE AS confidence_score FROM part",
)
def definition_lists(spark, sf_dir):
    """Terms of definition lists."""
    item = f"concat('<dt>', CASE WHEN p_partkey % 3 = 0 THEN concat('<a href=\"/t/', p_partkey, '\">', {_N}, '</a> (new)') ELSE {_N} END, '<dd>', p_type)"
    out = _records(spark, sf_dir, item, "<dl>", "</dl>", ["definitions"])
    return out.select("page_id", "name_en", "website_url", "confidence_score")


_LD = """concat('{"@type": "', CASE WHEN p_partkey % 4 = 0 THEN 'WebPage' ELSE 'LocalBusiness' END, '", "name": "', p_name, ' ', p_partkey, '", "url": "/o/', p_partkey, '", "telephone": "', 5550000 + p_partkey,
  '", "description": "', p_type, ' goods"}')"""


def _ld_pages(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {_PER_PAGE}").alias("page_id"), "p_partkey", F.expr(_LD).alias("item"))
    pages = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("items"))
    graph = F.array_join(F.transform("items", lambda x: x["item"]), ", ")
    html = F.concat(
        F.lit('<html><head><meta property="og:site_name" content="Guide"><meta name="description" content="A guide"><meta name="geo.placename" content="Riyadh">'
              '<script type="application/ld+json">{"@graph": ['), graph, F.lit("]}</script></head><body><p>x</body></html>"),
    )
    return pages.select("page_id", F.concat(F.lit("https://ld.example.org/p/"), F.col("page_id").cast("string")).alias("url"), html.alias("html"))


@query(
    "jsonld_records",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'https://ld.example.org/o/' || p_partkey AS website_url, '' || (5550000 + p_partkey) AS phone, p_type || ' goods' AS description_en, 'json_ld' AS strategy FROM part WHERE p_partkey % 4 <> 0""",
)
def jsonld_records(spark, sf_dir):
    """Organisations stated as JSON-LD."""
    out = ex.extract_records(h.parse_pages(_ld_pages(spark, sf_dir)))
    return out.select("page_id", "name_en", "website_url", "phone", "description_en", "strategy")


@query(
    "jsonld_harvest",
    f"""WITH p AS (SELECT p_partkey // {_PER_PAGE} AS page_id, * FROM part)
SELECT page_id, arg_min({_N}, p_partkey) AS name, arg_min(p_type || ' goods', p_partkey) AS description, arg_min('/o/' || p_partkey, p_partkey) AS site,
  count(*)::INTEGER AS n_phones, string_agg(DISTINCT CASE WHEN p_partkey % 4 <> 0 THEN 'LocalBusiness' END, ',') AS found_in, 'Riyadh' AS full_address FROM p GROUP BY 1""",
)
def jsonld_harvest(spark, sf_dir):
    """What JSON-LD and meta elements of a page say together; the first block to name a field wins."""
    out = fl.harvested(h.parse_pages(_ld_pages(spark, sf_dir)))
    return out.select("page_id", "name", "description", "site", F.size("phones").alias("n_phones"), F.array_join("found_in", ",").alias("found_in"), "full_address")


@query(
    "marker_records",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, 'شركة ' || p_partkey AS name_en, '' || (4030000000 + p_partkey) AS cr_number, CASE WHEN p_partkey % 2 = 0 THEN 'صنع ' || p_name END AS description_en,
  'https://list.example.org/Home/FactoryDetails/' || (4030000000 + p_partkey) AS source_url FROM part""",
)
def marker_records(spark, sf_dir):
    """Line-oriented listings: a marker line opens a record, the following lines fill it."""
    item = "concat('<p>رقم السجل التجاري ', 4030000000 + p_partkey, '</p><p>المصنع : شركة ', p_partkey, '</p><p>', CASE WHEN p_partkey % 2 = 0 THEN concat('صنع ', p_name) ELSE 'التفاصيل' END, '</p>')"
    out = ex.marker_records(h.parse_pages(_listing(spark, sf_dir, item, "<h1>دليل</h1>", "")))
    return out.select("page_id", "name_en", "cr_number", "description_en", "source_url")


@query(
    "sections",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, {_N} AS name_en, 'https://w' || p_partkey || '.sa' AS website_url, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey || '@b.sa' END AS email, 'Hall ' || p_size AS full_address,
  'We make ' || p_type || ' goods for everyone in the whole region' AS description_en, 0.72::DOUBLE AS confidence_score FROM part""",
)
def sections(spark, sf_dir):
    """Long guide pages: each heading section is a company with labelled lines."""
    item = f"""concat('<h3>', {_N}, '</h3><p>We make ', p_type, ' goods for everyone in the whole region</p><p>Website: w', p_partkey, '.sa</p>',
      CASE WHEN p_partkey % 2 = 0 THEN concat('<p>Email: a', p_partkey, '@b.sa</p>') ELSE '<p>Email: -</p>' END, '<p>Location: Hall ', p_size, '</p>')"""
    out = ex.article_sections(h.parse_pages(_listing(spark, sf_dir, item, "<nav><h3>Menu here</h3><p>x</p></nav><article><h2>Products</h2>", "</article><h3>Outside of it</h3>")))
    return out.select("page_id", "name_en", "website_url", "email", "full_address", "description_en", "confidence_score")


def _profile_pages(spark, sf_dir):
    key = "cast(p_partkey % 200 + 17 as int)"
    hexed = f"concat(lower(lpad(hex({key}), 2, '0')), array_join(transform(split(concat('m', p_partkey, '@b.sa'), ''), c -> lower(lpad(hex(ascii(c) ^ {key}), 2, '0'))), ''))"
    html = f"""concat('<html><head><title>Guide</title><meta property="og:title" content="', {_N}, '"><meta property="og:description" content="A long description of ', p_type, '"></head><body><nav><a href="tel:0000000">x</a></nav><article><h1>',
      CASE WHEN p_partkey % 7 = 0 THEN 'Quite another firm' ELSE p_name END, '</h1><p>Text that is long enough to be the main content of a profile page, one thinks.</p><a href="tel:+966-11-', 1000000 + p_partkey, '">call</a>',
      CASE WHEN p_partkey % 2 = 0 THEN concat('<span data-cfemail="', {hexed}, '"></span>') ELSE concat('<a href="mailto:m', p_partkey, '@b.sa?x">m</a>') END,
      '<a itemprop="url" href="https://facebook.com/x">f</a><a itemprop="url" href="https://p', p_partkey, '.sa/">w</a><img itemprop="image" src="/i/', p_partkey, '.png"><address>Gate ', p_size, '</address></article></body></html>')"""
    return spread(table(spark, sf_dir, "part"), 4).select(
        F.col("p_partkey").alias("page_id"), F.expr("concat('https://guide.example.org/', p_partkey)").alias("url"), F.expr(html).alias("html")
    )


@query(
    "profiles",
    f"""SELECT p_partkey AS page_id, {_N} AS name_en, '96611' || (1000000 + p_partkey) AS phone, 'm' || p_partkey || '@b.sa' AS email, 'https://p' || p_partkey || '.sa/' AS website_url,
  'A long description of ' || p_type AS description_en, 'https://guide.example.org/i/' || p_partkey || '.png' AS logo_url, 'Gate ' || p_size AS full_address FROM part WHERE p_partkey % 7 <> 0""",
)
def profiles(spark, sf_dir):
    """Profile pages: one record each; pages that speak of another company are left out."""
    out = ex.profiles(h.parse_pages(_profile_pages(spark, sf_dir)))
    return out.select("page_id", "name_en", "phone", "email", "website_url", "description_en", "logo_url", "full_address")


@query(
    "page_fields_full",
    """SELECT p_partkey AS page_id, 'https://p' || p_partkey || '.sa/' AS website, 'https://f.example.org/logo/' || p_partkey || '.png' AS logo, 'Gate ' || p_size || ', Riyadh' AS address,
  'a' || p_partkey || '@b.sa|c' || p_partkey || '@d.sa' AS emails, 'https://www.linkedin.com/company/c' || p_partkey AS linkedin, 'Person ' || p_partkey || '/CEO' AS team, 'https://f.example.org/hero/' || p_partkey || '.jpg' AS banner FROM part""",
)
def page_fields_full(spark, sf_dir):
    """Every field extractor on company pages written from the part table."""
    html = """concat('<html><head><link rel="canonical" href="/c/', p_partkey, '"></head><body><header><div class="logo"><img src="/logo/', p_partkey, '.png"></div></header><div class="hero"><img src="/hero/', p_partkey, '.jpg"></div>',
      '<a href="https://p', p_partkey, '.sa">Visit site</a><a href="mailto:a', p_partkey, '@b.sa?s=1">m</a> or c', p_partkey, '@d.sa <address> Gate ', p_size, ', Riyadh</address>',
      '<a href="https://www.linkedin.com/company/c', p_partkey, '">in</a><div class="team-member"><h4>Person ', p_partkey, '</h4><span class="role">CEO</span></div></body></html>')"""
    pages = spread(table(spark, sf_dir, "part"), 4).select(
        F.col("p_partkey").alias("page_id"), F.expr("concat('https://f.example.org/', p_partkey)").alias("url"), F.expr(html).alias("html")
    )
    asked = ("website", "logo", "address", "emails", "socials", "team")
    # fields and visuals of a page are found in one pass over it and kept, so that the join doesn't parse it twice
    both = written(fl.page_fields(h.parse_pages(pages), beside=[fl.visuals().alias("v")]).select("page_id", *asked, "v"), "page-fields")
    return both.drop("v").join(both.select("page_id", "v"), "page_id").select(
        "page_id", F.col("website.value").alias("website"), F.col("logo.value").alias("logo"), F.col("address.value").alias("address"),
        F.array_join("emails.value", "|").alias("emails"), F.concat(F.lit("https://www."), F.regexp_replace(F.col("socials.value")["linkedin"], "^https://", "")).alias("linkedin"),
        F.array_join(F.transform("team.value", lambda m: F.concat_ws("/", m["name"], m["role"])), "|").alias("team"), F.col("v.banner").alias("banner"),
    )


@query(
    "next_pages",
    f"""WITH p AS (SELECT DISTINCT p_partkey // {_PER_PAGE} AS page_id FROM part)
SELECT page_id, unnest(['https://list.example.org/p/' || page_id || '?page=2', 'https://list.example.org/next/' || page_id, 'https://list.example.org/p/3']) AS target FROM p""",
)
def next_pages(spark, sf_dir):
    """Pagination links by element rules and by the shape of the address."""
    pages = _listing(spark, sf_dir, "concat('<i>', p_partkey, '</i>')", '<div class="pagination"><a href="?page=2">2</a></div><a href="/p/3">three</a><a href="/other">o</a>', "")
    pages = pages.withColumn("html", F.concat("html", F.lit('<a rel="next" href="/next/'), F.col("page_id").cast("string"), F.lit('">n</a>')))
    return fl.next_pages(h.parse_pages(pages))


@query(
    "numbered_pages",
    f"""WITH p AS (SELECT p_partkey // {_PER_PAGE} AS page_id, max(p_size) AS total FROM part GROUP BY 1)
SELECT page_id, n::INTEGER AS page_no, 'https://list.example.org/p/' || page_id || '?page=' || n AS target FROM (SELECT page_id, unnest(range(2, total + 1)) AS n FROM p WHERE total >= 2)""",
)
def numbered_pages(spark, sf_dir):
    """Pages of listings that state how many they have."""
    p = table(spark, sf_dir, "part").groupBy(F.expr(f"p_partkey div {_PER_PAGE}").alias("page_id")).agg(F.max("p_size").alias("total"))
    pages = p.select("page_id", F.expr("concat('https://list.example.org/p/', page_id)").alias("url"), F.expr("concat('<p>Page 1 of ', total, '</p>')").alias("html"))
    return fl.numbered_pages(h.parse_pages(pages), r"Page 1 of (\d+)", "page")


@query(
    "api_listing",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, p_name AS name_en, p_type AS description_en, CASE WHEN p_partkey % 2 = 0 THEN 'https://vendors.example.org/v' || p_partkey ELSE 'https://api.example.org/' || (p_partkey // {_PER_PAGE}) END AS source_url FROM part""",
)
def api_listing(spark, sf_dir):
    """Vendor listings answered as JSON, nested one of three ways."""
    item = """concat('{"name": "', p_name, '", "details": "', p_type, '"', CASE WHEN p_partkey % 2 = 0 THEN concat(', "subdomain": "v', p_partkey, '"') ELSE '' END, '}')"""
    p = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {_PER_PAGE}").alias("page_id"), "p_partkey", F.expr(item).alias("item"))
    pages = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("items"))
    rows = F.concat(F.lit('{"data": ['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}"))
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"data": {"result": '), rows, F.lit("}}"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit('{"result": '), rows, F.lit("}"))
    ).otherwise(rows)
    pages = pages.select("page_id", F.concat(F.lit("https://api.example.org/"), F.col("page_id").cast("string")).alias("url"), body.alias("body"))
    return ex.api_listing(pages, "https://vendors.example.org/").select("page_id", "name_en", "description_en", "source_url")


@query("fallback_pages", "SELECT page_id, url FROM pages WHERE NOT contains(html, '<table') AND NOT contains(html, '<dl')")
def fallback_pages(spark, sf_dir):
    """Pages that rules for cards, tables and definition lists cannot read."""
    parsed = _parsed(spark, sf_dir)
    found = ex.extract_records(parsed, ["json_ld", "cards", "table", "definitions"])
    return ex.pages_without_records(parsed, found).select("page_id", "url")

"""Company-shaped views over the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.functions import urls
from tradebook.functions.fixed_values import TRACKING_KEYS
from tradebook.functions.semantics import squeeze
from tradebook.plans.registry import table


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies: id, name_en, city, region, balance."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name_en"), F.col("n_name").alias("city"),
            F.col("r_name").alias("region"), F.col("s_acctbal").alias("balance"),
        )
    )


COMPANIES_SQL = """companies AS (
  SELECT s_suppkey AS id, s_name AS name_en, n_name AS city, r_name AS region, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidate records: many share a name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name_en"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
    )


NAMES_SQL = """names AS (
  SELECT p_partkey AS id, p_name AS name_en, p_brand AS brand, p_type AS category, p_size AS size, p_retailprice AS price
  FROM part)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with canonical URL, domain, title and page type."""
    u = F.col("url")
    return (
        pages(spark, sf_dir)
        .select(
            "page_id", "url", "html",
            urls.canonical_url(u).alias("canonical_url"),
            urls.domain(u).alias("domain"),
            squeeze(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
            F.lower(urls.path(u)).alias("_path"),
        )
        .withColumn("_kind", urls.classify_page(F.col("_path")))
        .withColumns({"page_type": F.col("_kind.page_type"), "type_confidence": F.col("_kind.confidence")})
        .drop("_kind", "_path")
    )


_KEYS = ", ".join(f"'{k}'" for k in TRACKING_KEYS)


def query_sql(query: str, sort: bool) -> str:
    """SQL for a query string without tracking keys."""
    kept = (
        f"list_filter(string_split({query}, '&'), lambda x: x <> '' AND "
        f"lower(string_split(x, '=')[1]) NOT IN ({_KEYS}))"
    )
    if sort:
        kept = f"list_sort({kept})"
    text = f"array_to_string({kept}, '&')"
    return f"(CASE WHEN {text} = '' THEN '' ELSE '?' || {text} END)"


URL_PARTS_SQL = r"""url_parts AS (
  SELECT page_id, url, html,
    regexp_extract(url, '^(https?)://', 1) AS scheme,
    lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host,
    CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/'
         ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END AS path,
    regexp_extract(url, '\?([^#]*)', 1) AS query,
    regexp_extract(url, '(#.*)$', 1) AS fragment
  FROM pages)"""

_SLASH = "(CASE WHEN length(path) > 1 AND path LIKE '%/' THEN path[:-2] ELSE path END)"
CANONICAL_SQL = (
    f"'https://' || regexp_replace(host, '^www\\.', '') || {_SLASH} || {query_sql('query', True)} || fragment"
)
NORMAL_SQL = (
    f"scheme || '://' || regexp_replace(host, '^www\\.', '') || {_SLASH} || {query_sql('query', False)} || fragment"
)
UNTRACKED_SQL = f"scheme || '://' || host || path || {query_sql('query', False)} || fragment"


def page_type_sql(path: str, column: str) -> str:
    """CASE ladder of the ordered path patterns; column is page_type or confidence."""
    from tradebook.functions.fixed_values import PAGE_PATTERNS

    pick = (lambda kind, conf: f"'{kind}'") if column == "page_type" else (lambda kind, conf: f"{conf!r}::DOUBLE")
    clean = f"regexp_replace(lower({path}), '/$', '')"
    rows = [f"WHEN lower({path}) IN ('/', '/index.html', '/home', '/en', '/ar') THEN {pick('homepage', 0.95)}"]
    for word, kind, priority in PAGE_PATTERNS:
        rows.append(f"WHEN contains({clean}, '{word}') THEN {pick(kind, min(0.95, 0.5 + priority / 20))}")
    return f"(CASE {' '.join(rows)} ELSE {pick('other', 0.3)} END)"


SITES_SQL = f"""{URL_PARTS_SQL},
sites AS (
  SELECT page_id, url, html, {CANONICAL_SQL} AS canonical_url, regexp_replace(host, '^www\\.', '') AS domain,
    trim(regexp_replace(regexp_extract(html, '<title>((?s).*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
    {page_type_sql('path', 'page_type')} AS page_type,
    {page_type_sql('path', 'confidence')} AS type_confidence
  FROM url_parts)"""


def case_sql(value: str, order: list[tuple[str, int]], default: int) -> str:
    return "(CASE " + " ".join(f"WHEN {value} = '{k}' THEN {n}" for k, n in order) + f" ELSE {default} END)"


# Company rows with gaps and faults, made of customers.  The expressions read the same in both dialects.
RICH = {
    "id": "'' || c_custkey",
    "seq": "c_custkey",
    "name_en": "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Test Company' WHEN 2 THEN 'X' WHEN 3 THEN '  ' ELSE c_name END",
    "name_ar": "CASE c_custkey % 5 WHEN 0 THEN 'شركة ' || c_custkey WHEN 1 THEN 'Latin ' || c_custkey WHEN 2 THEN '' ELSE NULL END",
    "business_type": "CASE c_custkey % 4 WHEN 0 THEN 'vendor' WHEN 1 THEN 'Trader' WHEN 2 THEN lower(c_mktsegment) ELSE NULL END",
    "description_en": "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ' goods of all kinds for the region' WHEN 1 THEN 'short' ELSE NULL END",
    "description_ar": "CASE c_custkey % 6 WHEN 0 THEN 'وصف طويل للشركة ومنتجاتها وخدماتها رقم ' || c_custkey ELSE NULL END",
    "email": "CASE c_custkey % 7 WHEN 0 THEN 'info@' || lower(replace(c_name, '#', '')) || '.com' WHEN 1 THEN 'broken@' WHEN 2 THEN '' ELSE NULL END",
    "contact_email": "CASE c_custkey % 11 WHEN 0 THEN 'desk@example.org' ELSE NULL END",
    "sales_email": "CASE c_custkey % 13 WHEN 0 THEN 'sales@example.org' WHEN 1 THEN 'sales at' ELSE NULL END",
    "phone": "CASE c_custkey % 5 WHEN 0 THEN '+966 11 ' || (1000000 + c_custkey) WHEN 1 THEN '12' WHEN 2 THEN '05-' || (10000000 + c_custkey) ELSE NULL END",
    "website_url": "CASE c_custkey % 4 WHEN 0 THEN 'https://www.' || lower(replace(c_name, '#', '')) || '.com/' WHEN 1 THEN 'no url' ELSE NULL END",
    "logo_url": "CASE c_custkey % 9 WHEN 0 THEN 'https://img.example.org/' || c_custkey || '.png' ELSE NULL END",
    "linkedin_url": "CASE c_custkey % 10 WHEN 0 THEN 'https://www.linkedin.com/company/' || c_custkey WHEN 1 THEN 'https://example.org/in' ELSE NULL END",
    "full_address": "CASE c_custkey % 6 WHEN 0 THEN 'Saudi Arabia' WHEN 1 THEN 'Industrial Area, Gate ' || c_custkey ELSE NULL END",
    "city": "CASE c_custkey % 5 WHEN 0 THEN 'Riyadh' WHEN 1 THEN 'Q' WHEN 2 THEN 'Sector 7' ELSE NULL END",
    "city_id": "CASE c_custkey % 2 WHEN 0 THEN '1' ELSE NULL END",
    "slug": "CASE c_custkey % 3 WHEN 0 THEN 'c-' || c_custkey ELSE NULL END",
    "source_url": "'http://dir.example.org/list/' || c_nationkey || '/'",
    "data_source": "CASE c_custkey % 2 WHEN 0 THEN 'directory' ELSE NULL END",
    "cr_number": "CASE c_custkey % 8 WHEN 0 THEN '' || (1010000000 + c_custkey) ELSE NULL END",
    "status": "CASE c_custkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END",
    "is_verified": "c_custkey % 4 = 0",
    "score": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 1.4 WHEN 2 THEN -0.2 ELSE (c_custkey % 100) / 100.0 END",
    "categories_text": "CASE c_custkey % 5 WHEN 0 THEN 'Electrical|4| Unknown Category ' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'chemicals|2' ELSE NULL END",
    "products_text": "CASE c_custkey % 4 WHEN 0 THEN 'pump|  |valve' WHEN 1 THEN 'pipe' ELSE NULL END",
    "segment": "c_mktsegment",
    "balance": "c_acctbal",
    "nation": "c_nationkey",
}
RICH_SQL = "rich AS (SELECT " + ", ".join(
    f"({e})::DOUBLE AS {n}" if n == "score" else f"{e} AS {n}" for n, e in RICH.items()
) + ", string_split(categories_text, '|') AS categories, string_split(products_text, '|') AS products FROM customer)"


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers dressed as company rows of uneven quality."""
    df = table(spark, sf_dir, "customer").select(
        *[F.expr(e).cast("double").alias(n) if n == "score" else F.expr(e).alias(n) for n, e in RICH.items()]
    )
    return df.withColumns(
        {
            "categories": F.split("categories_text", r"\|"),
            "products": F.split("products_text", r"\|"),
        }
    )

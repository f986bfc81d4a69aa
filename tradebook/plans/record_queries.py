"""Queries over company records: validation, shaping, scores, audits, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.operators import categories as cat
from tradebook.operators import records as rec
from tradebook.plans import views as v
from tradebook.plans.registry import query, table
from tradebook.sources.schemas import with_missing

def _as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")

# the validation rules once more, as SQL
_LATIN = "'^[a-zA-Z0-9\\s\\x{00c0}-\\x{017f}\\x{21}-\\x{2f}\\x{3a}-\\x{40}\\x{5b}-\\x{60}\\x{7b}-\\x{7e}]+$'"
_ARABIC = (
    "'^[\\x{0600}-\\x{06ff}\\s\\x{0750}-\\x{077f}\\x{08a0}-\\x{08ff}a-zA-Z0-9\\x{2000}-\\x{206f}\\x{2e00}-\\x{2e7f}"
    "\\x{21}-\\x{2f}:;<=>?@\\[\\]^_`{|}~\\\\]+$'"
)
_EN_OK = f"coalesce(length(trim(name_en)) BETWEEN 2 AND 200 AND regexp_matches(name_en, {_LATIN}), false)"
_AR_OK = f"coalesce(length(trim(name_ar)) BETWEEN 2 AND 200 AND regexp_matches(name_ar, {_ARABIC}), false)"
_ERRORS_SQL = f"""array_to_string(list_filter([
  CASE WHEN NOT {_EN_OK} AND NOT {_AR_OK} THEN 'Company name in English is required and must be valid' END,
  CASE WHEN business_type <> '' AND lower(business_type) NOT IN ('vendor', 'manufacturer', 'trader') THEN 'Invalid business type. Must be "vendor", "manufacturer", or "trader"' END,
  CASE WHEN website_url <> '' AND NOT regexp_matches(website_url, '^https?://[^\\s/?#]+') THEN 'Invalid website URL: ' || website_url END,
  CASE WHEN phone <> '' AND NOT regexp_matches(regexp_replace(phone, '[\\s\\-()+.]', '', 'g'), '^\\d{{7,15}}$') THEN 'Invalid phone number: ' || phone END,
  CASE WHEN email <> '' AND NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') THEN 'Invalid email: ' || email END,
  CASE WHEN city <> '' AND NOT (length(trim(city)) BETWEEN 2 AND 100 AND regexp_matches(trim(city), '^[a-zA-Z\\x{{00c0}}-\\x{{017f}}\\s''-]+$')) THEN 'Invalid city name: ' || city END,
  CASE WHEN categories IS NOT NULL AND len(list_filter(categories, lambda x: trim(x) = '' OR length(x) > 200)) > 0 THEN 'Categories array contains invalid entries' END,
  CASE WHEN products IS NOT NULL AND len(list_filter(products, lambda x: trim(x) = '' OR length(x) > 200)) > 0 THEN 'Products array contains invalid entries' END
], lambda x: x IS NOT NULL), '; ')"""
_WARNINGS_SQL = f"""array_to_string(list_filter([
  CASE WHEN NOT {_EN_OK} AND {_AR_OK} THEN 'English name is missing; using Arabic company name as fallback' END,
  CASE WHEN name_ar <> '' AND NOT {_AR_OK} THEN 'Arabic name provided but appears to be invalid' END
], lambda x: x IS NOT NULL), '; ')"""


@query(
    "validate_errors",
    f"WITH {v.RICH_SQL} SELECT id, {_ERRORS_SQL} AS errors, {_WARNINGS_SQL} AS warnings, {_ERRORS_SQL} = '' AS is_valid FROM rich",
)
def validate_errors(spark, sf_dir):
    """Every record with its errors and warnings."""
    out = rec.validated(v.rich(spark, sf_dir))
    return out.select(
        "id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid"
    )


@query(
    "validate_split",
    f"""WITH {v.RICH_SQL}, e AS (SELECT id, {_ERRORS_SQL} AS errors FROM rich)
SELECT id, len(string_split(errors, '; '))::INTEGER AS error_count, errors AS reason, 'pending' AS status FROM e WHERE errors <> ''""",
)
def validate_split(spark, sf_dir):
    """The rejected records as rows of the review queue."""
    checked = rec.validated(v.rich(spark, sf_dir))
    queue = rec.review_queue(checked.where("not is_valid"), "id", _as_of())
    return queue.select(F.col("company_id").alias("id"), "error_count", "reason", "status")


_MAIL_BAD = "NOT regexp_matches({0}, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')"


@query(
    "validate_for_save",
    f"""WITH {v.RICH_SQL} SELECT id, array_to_string(list_filter([
  CASE WHEN trim(coalesce(name_en, '')) = '' THEN 'name_en is required' END, CASE WHEN coalesce(slug, '') = '' THEN 'slug is required' END,
  CASE WHEN coalesce(business_type, '') = '' THEN 'business_type is required' END,
  CASE WHEN email <> '' AND {_MAIL_BAD.format('email')} THEN 'email has invalid email format: "' || email || '"' END,
  CASE WHEN sales_email <> '' AND {_MAIL_BAD.format('sales_email')} THEN 'sales_email has invalid email format: "' || sales_email || '"' END,
  CASE WHEN website_url <> '' AND NOT regexp_matches(website_url, '^https?://.+') THEN 'website_url has invalid URL format: "' || website_url || '"' END,
  CASE WHEN score IS NOT NULL AND NOT score BETWEEN 0 AND 1 THEN 'confidence_score out of range: ' || score END], lambda x: x IS NOT NULL), '; ') AS errors,
  array_to_string(list_filter([CASE WHEN linkedin_url <> '' AND NOT contains(linkedin_url, 'linkedin.com') THEN 'linkedin_url does not contain "linkedin.com"' END,
  CASE WHEN phone <> '' AND NOT regexp_matches(regexp_replace(phone, '[\\s\\-().]', '', 'g'), '^\\+?\\d{{7,15}}$') THEN 'phone format looks unusual: "' || phone || '"' END,
  CASE WHEN description_en <> '' AND length(description_en) < 10 THEN 'description_en is very short (< 10 chars)' END,
  CASE WHEN coalesce(city_id, '') = '' THEN 'city_id is missing, will use default' END, 'region_id is missing, will use default'], lambda x: x IS NOT NULL), '; ') AS warnings FROM rich""",
)
def validate_for_save(spark, sf_dir):
    """The stricter rules before a record is stored."""
    out = rec.validated_for_save(v.rich(spark, sf_dir).withColumn("confidence_score", F.col("score")))
    return out.select("id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(
    "confidence_clamp",
    f"""WITH {v.RICH_SQL} SELECT id, (CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 0 END)::DOUBLE AS score,
  (CASE WHEN balance / 10000 BETWEEN 0 AND 1 THEN round(balance / 10000, 6) ELSE 0 END)::DOUBLE AS field_score,
  NOT (score IS NOT NULL AND score BETWEEN 0 AND 1 AND balance / 10000 BETWEEN 0 AND 1) AS clamped FROM rich""",
)
def confidence_clamp(spark, sf_dir):
    """Scores outside 0..1 become 0, alone and inside a map; the flag tells whether any did."""
    r = v.rich(spark, sf_dir).select(
        "id", F.col("score").alias("confidence_score"),
        F.create_map(F.lit("name_en"), F.col("balance") / 10000).alias("field_confidence"),
    )
    out = rec.clamp_payload(r)
    return out.select(
        "id", F.col("confidence_score").alias("score"), F.round(F.col("field_confidence")["name_en"], 6).alias("field_score"), "clamped"
    )


@query(
    "sanitize_records",
    f"""WITH {v.RICH_SQL} SELECT id, CASE WHEN trim(coalesce(name_en, '')) = '' AND trim(coalesce(name_ar, '')) <> '' THEN trim(name_ar) WHEN name_en IS NULL THEN NULL ELSE trim(name_en) END AS name_en,
  CASE WHEN website_url <> '' AND NOT regexp_matches(website_url, '^https?://') THEN 'https://' || website_url ELSE website_url END AS website_url,
  CASE WHEN full_address <> '' THEN full_address WHEN city <> '' THEN segment || ', ' || city ELSE segment END AS full_address,
  description_en AS description_en FROM rich""",
)
def sanitize_records(spark, sf_dir):
    """Records freed of script text; address and city end up in full_address."""
    raw = v.rich(spark, sf_dir).withColumn("address", F.col("segment"))
    raw = raw.withColumn(
        "description_en",
        F.concat(F.lit("<script>var a = '<b>';</script>"), F.col("description_en"), F.lit(" <iframe src=x></iframe>")),
    )
    return rec.sanitized(raw).select("id", "name_en", "website_url", "full_address", "description_en")


@query(
    "storable_records",
    f"""WITH {v.RICH_SQL} SELECT id, (CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 0 END)::DOUBLE AS confidence_score,
  CASE WHEN full_address <> '' THEN full_address WHEN city <> '' THEN city ELSE full_address END AS full_address FROM rich""",
)
def storable_records(spark, sf_dir):
    raw = v.rich(spark, sf_dir).select("id", F.col("score").alias("confidence_score"), "city", "full_address")
    return rec.storable(raw)


@query(
    "candidates_cleaned",
    f"""WITH {v.RICH_SQL} SELECT id, trim(coalesce(name_en, '')) AS name_en, trim(coalesce(name_ar, '')) AS name_ar,
  regexp_replace(coalesce(phone, ''), '[\\s\\-()+.]', '', 'g') AS phone,
  lower(CASE WHEN website_url <> '' AND NOT starts_with(website_url, 'http') THEN 'https://' || website_url ELSE website_url END) AS website_url,
  array_to_string(list_filter(list_transform(products, lambda x: trim(x)), lambda x: x <> ''), '|') AS products
FROM rich WHERE trim(coalesce(name_en, '')) <> '' OR trim(coalesce(name_ar, '')) <> ''""",
)
def candidates_cleaned(spark, sf_dir):
    """Extracted candidates made uniform, nameless ones dropped."""
    out = rec.cleaned_candidates(v.rich(spark, sf_dir))
    return out.select(
        "id", "name_en", "name_ar", "phone", "website_url",
        F.when(F.col("products").isNotNull(), F.array_join("products", "|")).alias("products"),
    )


_NAME_OR = "coalesce(CASE WHEN trim(name_en) <> '' THEN trim(name_en) END, 'Unknown Company')"
_CAT_SQL = "CASE " + " ".join(
    f"WHEN x = '{c[0]}' OR lower(x) = '{c[1].lower()}' OR x = '{c[2]}' THEN '{c[0]}'" for c in fv.CATEGORIES
) + " ELSE x END"
_CATS = f"list_transform(list_filter(list_transform(categories, lambda x: trim(x)), lambda x: x <> ''), lambda x: {_CAT_SQL})"


@query(
    "discovered_records",
    f"""WITH {v.RICH_SQL} SELECT id, {_NAME_OR} AS name_en, coalesce(CASE WHEN trim(name_ar) <> '' THEN trim(name_ar) END, {_NAME_OR}) AS name_ar,
  coalesce(slug, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({_NAME_OR}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS slug,
  coalesce(business_type, 'vendor') AS business_type, coalesce(description_en, {_NAME_OR}) AS description_en,
  coalesce(array_to_string({_CATS}, '|'), '') AS categories,
  coalesce(array_to_string(list_filter(list_transform(products, lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS products,
  coalesce(full_address, city, 'Saudi Arabia') AS full_address, coalesce(city_id, '1') AS city_id, status, coalesce(data_source, 'AI Agent') AS data_source,
  (CASE WHEN score BETWEEN 0 AND 1 THEN score ELSE 0 END)::DOUBLE AS confidence_score FROM rich""",
)
def discovered_records(spark, sf_dir):
    """Discovered candidates in their stored shape."""
    out = rec.discovered_record(v.rich(spark, sf_dir).withColumn("confidence_score", F.col("score")), _as_of())
    return out.select(
        "id", "name_en", "name_ar", "slug", "business_type", "description_en",
        F.array_join("categories", "|").alias("categories"), F.array_join("products", "|").alias("products"),
        "full_address", "city_id", "status", "data_source", "confidence_score",
    )


_ANSWER = (
    """'noise before {"phone": "' || coalesce(phone, '') || '", "products": ["pump", 7, "valve"], "fields": [" a ", ""], "is_vat_registered": "'"""
    """ || CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'maybe' END || '", "confidence_score": ' || CASE c_custkey % 4 WHEN 0 THEN '0.5' WHEN 1 THEN '7' ELSE '"high"' END"""
    """ || ', "team_members": [{"name": " A ", "role": "CEO"}, {"name": "B"}, 3], "categories": ["Electrical", "x"], "unknown": 1} after'"""
)


@query(
    "enrichment_updates",
    f"""WITH {v.RICH_SQL} SELECT id, phone AS phone, 'pump|valve' AS products, 'a' AS fields, '2|x' AS categories,
  CASE seq % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_vat_registered,
  (CASE seq % 4 WHEN 0 THEN 0.5 ELSE 0 END)::DOUBLE AS confidence_score, 'A/CEO' AS team FROM rich""",
)
def enrichment_updates(spark, sf_dir):
    """Answers read leniently, reduced to the allowed fields and coerced."""
    answers = v.rich(spark, sf_dir).select("id", F.expr(_ANSWER.replace("c_custkey", "seq")).alias("answer"))
    parsed = answers.select("id", tx.lenient_json(F.col("answer")).alias("payload"))
    out = parsed.select("id", *rec.enrichment_update(F.col("payload")))
    return out.select(
        "id", "phone", F.array_join("products", "|").alias("products"), F.array_join("fields", "|").alias("fields"),
        F.array_join("categories", "|").alias("categories"), "is_vat_registered", "confidence_score",
        F.array_join(F.transform("team_members", lambda m: F.concat_ws("/", m["name"], m["role"])), "|").alias("team"),
    )


# --- scores -------------------------------------------------------------------------------------------

_NAMED = "(coalesce(name_en, '') <> '' OR coalesce(name_ar, '') <> '')"


@query(
    "data_quality",
    f"""WITH {v.RICH_SQL} SELECT id, round(((CASE WHEN {_NAMED} THEN 1 ELSE 0 END) + (CASE WHEN website_url <> '' THEN 1 ELSE 0 END) + (CASE WHEN phone <> '' THEN 1 ELSE 0 END)
  + (CASE WHEN email <> '' THEN 1 ELSE 0 END) + (CASE WHEN logo_url <> '' THEN 1 ELSE 0 END) + (CASE WHEN description_en <> '' OR description_ar <> '' THEN 1 ELSE 0 END)) / 6.0::DOUBLE, 2) AS score,
  CASE WHEN NOT {_NAMED} THEN 'failed_parse' WHEN website_url <> '' OR phone <> '' OR email <> '' OR logo_url <> '' THEN 'success' ELSE 'partial' END AS scrape_status FROM rich""",
)
def data_quality(spark, sf_dir):
    r = v.rich(spark, sf_dir)
    return r.select("id", rec.data_quality().alias("score"), rec.scrape_status().alias("scrape_status"))


def _points(rows: list[tuple[str, int]]) -> str:
    return " + ".join(f"(CASE WHEN {cond} THEN {w} ELSE 0 END)" for cond, w in rows)


_GENERIC = ", ".join(f"'{g}'" for g in fv.GENERIC_NAMES)
_W = fv.RUBRIC_WEIGHTS
_RUBRIC_SQL = _points([
    (f"trim(name_en) <> '' AND lower(trim(name_en)) NOT IN ({_GENERIC})", _W["name_en"]),
    ("trim(name_ar) <> ''", _W["name_ar"]),
    ("length(description_en) >= 30", _W["description_en"]),
    ("length(description_ar) >= 30", _W["description_ar"]),
    ("business_type <> '' AND business_type <> 'vendor'", _W["business_type"]),
    ("email <> '' OR contact_email <> '' OR sales_email <> ''", _W["any_email"]),
    ("phone <> ''", _W["phone"]), ("website_url <> ''", _W["website_url"]),
    ("lower(full_address) <> 'saudi arabia' AND length(full_address) > 15", _W["address"]),
    ("linkedin_url <> ''", _W["social"]),
    ("len(categories) > 0", _W["categories"]), ("len(categories) >= 2", _W["two_categories"]), ("len(products) > 0", _W["products"]),
    ("source_url <> ''", _W["source_url"]), ("data_source <> ''", _W["data_source"]), ("cr_number <> ''", _W["registry"]),
])


@query("confidence_rubric", f"WITH {v.RICH_SQL} SELECT id, ({_RUBRIC_SQL}) / 100.0::DOUBLE AS new_score FROM rich")
def confidence_rubric(spark, sf_dir):
    """The weighted confidence of every record."""
    return rec.rescored(v.rich(spark, sf_dir), "score").select("id", "new_score")


@query(
    "rescore_changes",
    f"""WITH {v.RICH_SQL}, s AS (SELECT id, score, ({_RUBRIC_SQL}) / 100.0::DOUBLE AS new_score FROM rich)
SELECT id, score AS old_score, new_score FROM s WHERE abs(new_score - coalesce(score, 0)) > 0.005""",
)
def rescore_changes(spark, sf_dir):
    """Records whose stored score no longer fits."""
    out = rec.rescored(v.rich(spark, sf_dir), "score").where("changed")
    return out.select("id", F.col("score").alias("old_score"), "new_score")


@query(
    "score_histogram",
    f"""WITH {v.RICH_SQL}, s AS (SELECT ({_RUBRIC_SQL}) AS p FROM rich)
SELECT least(p // 20, 4)::INTEGER AS bucket, count(*) AS n, round(sum(p) / 100.0::DOUBLE / count(*), 4) AS mean_score FROM s GROUP BY 1""",
)
def score_histogram(spark, sf_dir):
    return rec.score_histogram(rec.rescored(v.rich(spark, sf_dir), "score"), "new_score")


@query(
    "completeness",
    f"""WITH {v.RICH_SQL}, f AS (SELECT id,
  ((CASE WHEN trim(email) <> '' THEN 1 ELSE 0 END) + (CASE WHEN phone <> '' THEN 1 ELSE 0 END) + (CASE WHEN website_url <> '' THEN 1 ELSE 0 END) + (CASE WHEN linkedin_url <> '' THEN 1 ELSE 0 END)) / 5.0::DOUBLE AS contact,
  ((CASE WHEN len(products) > 0 THEN 2 ELSE 0 END) + (CASE WHEN len(categories) > 0 THEN 2 ELSE 0 END) + (CASE WHEN description_en <> '' THEN 1 ELSE 0 END)) / 6.0::DOUBLE AS service,
  (CASE WHEN linkedin_url <> '' THEN 1 ELSE 0 END) / 4.0::DOUBLE AS social,
  ((CASE WHEN full_address <> '' THEN 1 ELSE 0 END) + (CASE WHEN city_id <> '' THEN 1 ELSE 0 END)) / 3.0::DOUBLE AS location,
  ((CASE WHEN logo_url <> '' THEN 1 ELSE 0 END) + (CASE WHEN is_verified THEN 1 ELSE 0 END) + 1) / 3.0::DOUBLE AS evidence,
  ((CASE WHEN trim(name_ar) <> '' THEN 1 ELSE 0 END) + (CASE WHEN description_ar <> '' THEN 1 ELSE 0 END)) / 3.0::DOUBLE AS bilingual FROM rich),
o AS (SELECT *, (contact + service + social + location + evidence + bilingual) / 7.0 AS overall FROM f)
SELECT id, floor(contact * 100 + 0.5)::INTEGER AS score_contact, floor(service * 100 + 0.5)::INTEGER AS score_service, floor(location * 100 + 0.5)::INTEGER AS score_location,
  floor(bilingual * 100 + 0.5)::INTEGER AS score_bilingual, floor(overall * 100 + 0.5)::INTEGER AS score_overall,
  CASE WHEN overall >= 0.8 THEN 'A' WHEN overall >= 0.6 THEN 'B' WHEN overall >= 0.4 THEN 'C' ELSE 'D' END AS grade,
  array_to_string(list_filter([CASE WHEN contact < 0.4 THEN 'Add contact details' END, CASE WHEN service < 0.4 THEN 'Add product/service descriptions' END, 'Add represented brands',
    CASE WHEN location < 0.5 THEN 'Complete location fields' END, CASE WHEN bilingual < 0.5 THEN 'Add Arabic translations' END], lambda x: x IS NOT NULL), '; ') AS advice FROM o""",
)
def completeness(spark, sf_dir):
    out = rec.completeness(v.rich(spark, sf_dir))
    return out.select(
        "id", "score_contact", "score_service", "score_location", "score_bilingual", "score_overall", "grade",
        F.array_join("recommendations", "; ").alias("advice"),
    )


@query(
    "quality_audit",
    f"""WITH {v.RICH_SQL}, o AS (SELECT * FROM rich ORDER BY balance, id LIMIT 100)
SELECT id, coalesce(score, 0) < 0.5 AS low_confidence, coalesce(description_en, '') = '' AND coalesce(description_ar, '') = '' AS missing_critical,
  coalesce(score, 0) < 0.5 OR (coalesce(description_en, '') = '' AND coalesce(description_ar, '') = '') AS is_bad FROM o""",
)
def quality_audit(spark, sf_dir):
    """The hundred records updated longest ago and what is wrong with them; balance stands for the time."""
    r = v.rich(spark, sf_dir).withColumns({"confidence_score": F.col("score"), "updated_at": F.col("balance")})
    return rec.quality_audit(r, 100).select("id", "low_confidence", "missing_critical", "is_bad")


@query(
    "gap_analysis",
    f"""WITH {v.RICH_SQL} SELECT count(*) AS total, count_if(coalesce(logo_url, '') = '')::BIGINT AS missing_logo, count_if(coalesce(website_url, '') = '')::BIGINT AS missing_website,
  count_if(coalesce(email, '') = '' AND coalesce(contact_email, '') = '')::BIGINT AS missing_email, count_if(coalesce(phone, '') = '')::BIGINT AS missing_phone,
  count_if(coalesce(description_ar, '') = '')::BIGINT AS missing_description_ar, count_if(coalesce(cr_number, '') = '')::BIGINT AS missing_cr_vat,
  count_if(score < 0.5)::BIGINT AS low_confidence, count_if(coalesce(name_ar, '') = '')::BIGINT AS missing_name_ar, count_if(name_ar <> '' AND regexp_matches(name_ar, '[a-zA-Z]'))::BIGINT AS name_ar_english FROM rich""",
)
def gap_analysis(spark, sf_dir):
    r = with_missing(v.rich(spark, sf_dir).withColumn("confidence_score", F.col("score")), ["vat_number"])
    return rec.gap_counts(r)


@query(
    "answers_sufficient",
    f"""WITH {v.RICH_SQL} SELECT id, {_NAMED} AS discovery_ok,
  ((CASE WHEN length(name_en) > 10 THEN 1 ELSE 0 END) + (CASE WHEN length(description_en) > 10 THEN 1 ELSE 0 END) + (CASE WHEN len(categories) > 0 THEN 1 ELSE 0 END)) >= 2 AS enrichment_ok FROM rich""",
)
def answers_sufficient(spark, sf_dir):
    return v.rich(spark, sf_dir).select(
        "id", rec.is_answer_sufficient("discovery").alias("discovery_ok"), rec.is_answer_sufficient("enrichment").alias("enrichment_ok")
    )


_VALID_CATS = ["electrical", "chemicals", "4", "2", "machinery"]


@query(
    "short_rubric",
    f"""WITH {v.RICH_SQL} SELECT id, ({_points([
        ("name_en <> ''", 20), ("description_en <> ''", 10), ("description_ar <> ''", 10), ("logo_url <> ''", 10), ("website_url <> ''", 10),
        ("email <> '' OR contact_email <> ''", 10), ("phone <> ''", 10),
        ("len(categories) > 0 AND len(list_filter(categories, lambda x: lower(x) NOT IN (" + ", ".join(f"'{c}'" for c in _VALID_CATS) + "))) = 0", 20)])}) / 100.0::DOUBLE AS score FROM rich""",
)
def short_rubric(spark, sf_dir):
    return v.rich(spark, sf_dir).select("id", rec.short_rubric(_VALID_CATS).alias("score"))


# --- categories ------------------------------------------------------------------------------------------

_DIM_SQL = "dim AS (SELECT DISTINCT lower(p_type) AS id, p_type AS name_en FROM part)"


@query(
    "category_map",
    f"""WITH {_DIM_SQL}, x AS (SELECT id, unnest(string_split(lower(name_en) || '|' || category || '|' || lower(category) || '|' || brand, '|')) AS value,
    unnest(range(0, 4))::INTEGER AS pos FROM (SELECT p_partkey AS id, p_name AS name_en, p_type AS category, p_brand AS brand FROM part))
SELECT x.id, pos, coalesce(d.id, n.id, value) AS category_id FROM x LEFT JOIN dim d ON d.id = value LEFT JOIN dim n ON lower(n.name_en) = lower(value)""",
)
def category_map(spark, sf_dir):
    """Category words of records -> ids of the dimension, unknown words kept."""
    dim = table(spark, sf_dir, "part").select(F.lower("p_type").alias("id"), F.col("p_type").alias("name_en")).distinct()
    words = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.posexplode(F.array(F.lower("p_name"), F.col("p_type"), F.lower("p_type"), F.col("p_brand"))).alias("pos", "value"),
    )
    return cat.mapped(words, dim).select("id", "pos", "category_id")


@query(
    "category_keyword",
    """WITH dim AS (SELECT DISTINCT p_name AS id FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
m AS (SELECT DISTINCT p.p_partkey AS id, d.id AS category_id FROM part p JOIN dim d ON contains(p.p_name, d.id) OR contains(lower(p.p_type), d.id))
SELECT id, category_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY category_id) AS rank FROM m) WHERE rank <= 3""",
)
def category_keyword(spark, sf_dir):
    """Fallback categories: names of the dimension found in the name or the description, three at most."""
    part = table(spark, sf_dir, "part")
    dim = (
        part.select(F.col("p_name").alias("id"))
        .union(part.select(F.split_part("p_name", F.lit(" "), F.lit(2))))
        .distinct()
        .withColumn("name_en", F.col("id"))
    )
    recs = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name_en"), F.col("p_type").alias("description_en"))
    return cat.by_keyword(recs, dim, "id", 3).select("id", "category_id", F.col("rank").cast("long").alias("rank"))


@query(
    "suggested_labels",
    """WITH dim AS (SELECT DISTINCT lower(p_type) AS id, p_brand AS name_en FROM part),
s AS (SELECT p_partkey AS id, unnest([lower(p_type), lower(p_brand), 'nothing']) AS label FROM part),
i AS (SELECT DISTINCT id FROM dim), n AS (SELECT lower(name_en) AS name, min(id) AS id FROM dim GROUP BY 1)
SELECT DISTINCT s.id, coalesce(i.id, n.id) AS category_id FROM s LEFT JOIN i ON i.id = label LEFT JOIN n ON n.name = label WHERE coalesce(i.id, n.id) IS NOT NULL""",
)
def suggested_labels(spark, sf_dir):
    """Suggested label lists matched to valid ids by id, else by name."""
    part = table(spark, sf_dir, "part")
    dim = part.select(F.lower("p_type").alias("id"), F.col("p_brand").alias("name_en")).distinct()
    sug = part.select(F.col("p_partkey").alias("id"), F.concat_ws(", ", F.lit("'"), F.col("p_type"), F.col("p_brand"), F.lit("nothing")).alias("answer"))
    # brand names hold no blanks, so the answer can be split at blanks and commas
    return cat.from_labels(sug, dim, "id", "answer").select("id", "category_id").distinct()


@query(
    "top_categories",
    """SELECT p_type AS category, count(*) AS n FROM (SELECT p_type FROM part UNION ALL SELECT p_brand FROM part) GROUP BY 1 ORDER BY n DESC, category LIMIT 5""",
)
def top_categories(spark, sf_dir):
    """The five most frequent category values."""
    arrays = table(spark, sf_dir, "part").select(F.array("p_type", "p_brand").alias("categories"))
    return cat.frequency(arrays, "categories", 5)


@query(
    "numeric_categories",
    f"""WITH {v.RICH_SQL} SELECT id FROM rich WHERE len(list_filter(categories, lambda x: regexp_matches(x, '^[0-9]+$'))) > 0""",
)
def numeric_categories(spark, sf_dir):
    """Records that hold a bare number among their categories."""
    return v.rich(spark, sf_dir).where(F.exists("categories", lambda x: x.rlike("^[0-9]+$"))).select("id")

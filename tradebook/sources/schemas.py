"""Column lists and types of the tables, one place for all readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _B, _L, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.TimestampType()
_A = T.ArrayType(T.StringType())


def _struct(**groups: tuple[T.DataType, str]) -> T.StructType:
    fields = []
    for dtype, names in groups.values():
        fields += [T.StructField(n, dtype) for n in names.split()]
    return T.StructType(fields)


COMPANY = _struct(
    identity=(_S, "id slug name_en name_ar"),
    public=(_L, "public_company_id"),
    kind=(_S, "business_type"),
    lists=(
        _A,
        "categories brands products services fields locations secondary_emails secondary_phones secondary_websites "
        "secondary_linkedin secondary_socials source_links merged_from",
    ),
    text=(
        _S,
        "description_en description_ar scope_en scope_ar seo_title_en seo_title_ar seo_description_en seo_description_ar",
    ),
    contact=(
        _S,
        "email contact_email sales_email procurement_email phone whatsapp website_url logo_url cover_image_url linkedin_url "
        "instagram_url twitter_url facebook_url youtube_url tiktok_url procurement_portal_url",
    ),
    place=(_S, "city_id region_id full_address"),
    point=(_D, "latitude longitude"),
    registry=(_S, "cr_number vat_number chamber_commerce_id"),
    flags=(_B, "is_vat_registered is_verified is_featured"),
    state=(_S, "status claim_status master_id duplicate_reason"),
    provenance=(_S, "data_source source_url source_domain raw_text raw_json extraction_method extraction_metadata"),
    scores=(_D, "confidence_score data_quality_score"),
    scraped=(_S, "scrape_status"),
    times=(_TS, "created_at updated_at first_seen_at last_seen_at last_scraped_at last_enriched_at"),
).add("field_confidence", T.MapType(_S, _D)).add(
    "team_members", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("role", _S)]))
)

SOURCE_PAGE = _struct(
    ids=(_S, "id url canonical_url domain page_type html text_content title status crawl_job_id seed_id"),
    codes=(T.IntegerType(), "response_code fetch_time_ms html_size_bytes"),
    headers=(_S, "response_headers fetch_method"),
    times=(_TS, "crawled_at"),
)

FIELD_EVIDENCE = _struct(
    key=(_S, "company_id field_name"),
    body=(_S, "value source_url source_page_id extraction_method extraction_detail"),
    score=(_D, "confidence"),
    lock=(_B, "is_locked"),
)

COMPANY_CONTACT = _struct(
    key=(_S, "company_id contact_type"), body=(_S, "email phone whatsapp source_url"), flag=(_B, "verified")
)

CRAWL_JOB = _struct(
    key=(_S, "id queue_name status url payload error_message idempotency_key worker_id"),
    counts=(T.IntegerType(), "priority attempts max_attempts"),
    times=(_TS, "created_at updated_at scheduled_at completed_at"),
)

SEED = _struct(
    key=(_S, "id url canonical_url domain source_type status error"),
    tags=(_A, "tags"),
    counts=(T.IntegerType(), "depth max_depth companies_found pages_scraped"),
    times=(_TS, "added_at processed_at"),
)

METRIC_POINT = _struct(key=(_S, "metric"), value=(_D, "value"), ts=(_TS, "ts")).add("tags", T.MapType(_S, _S))

SEARCH_ROW = _struct(
    key=(_S, "id name_en name_ar business_type description_en description_ar city"),
    lists=(_A, "categories products services brands"),
    text=(_S, "searchable_text"),
    times=(_TS, "last_updated"),
)

INQUIRY = _struct(
    key=(_S, "id company_id company_name sender_name sender_email subject message status type"), times=(_TS, "created_at")
)
CLAIM_REQUEST = _struct(
    key=(_S, "id company_id company_name claimant_name claimant_email status note"), times=(_TS, "created_at updated_at")
)
CRAWL_SCHEDULE = _struct(
    key=(_S, "id url frequency"), flag=(_B, "is_active"), times=(_TS, "last_run_at next_run_at created_at updated_at")
)
PROVIDER_LOG = _struct(
    key=(_S, "id provider model type status error_message usage request_payload response_payload"),
    ms=(T.IntegerType(), "duration_ms"),
    times=(_TS, "created_at"),
)

# keys that appear in payloads but are no columns of the company table
NOT_STORED = ["city", "address", "field_confidence", "field_evidence", "company_details"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order: missing ones null, unknown ones dropped, types cast."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def with_missing(df: DataFrame, columns: list[str], schema: T.StructType = COMPANY) -> DataFrame:
    """Adds the named company columns a table does not have, as typed nulls."""
    return df.withColumns(
        {c: F.lit(None).cast(schema[c].dataType) for c in columns if c not in df.columns}
    )

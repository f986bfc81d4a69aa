"""Record rules: validation, sanitising, confidence clamps, scores and audits of company rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.semantics import (
    first_truthy,
    flag,
    has_items,
    has_value,
    round_half_up,
    trim_blanks,
    truthy,
)
from tradebook.sources.schemas import NOT_STORED, with_missing

# --- field predicates ----------------------------------------------------------------------------


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$") & (F.length(c) <= 254), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(tx.phone_digits(c).rlike(r"^\d{7,15}$"), F.lit(False))


def is_name(c: Column, language: str) -> Column:
    """2 to 200 characters of the script's letters, digits and punctuation."""
    latin = r"^[a-zA-Z0-9\s\u00c0-\u017f\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$"
    arabic = (
        r"^[\u0600-\u06ff\s\u0750-\u077f\u08a0-\u08ffa-zA-Z0-9\u2000-\u206f\u2e00-\u2e7f"
        r"\\!\"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~]+$"
    )
    return F.coalesce(
        F.length(trim_blanks(c)).between(2, 200) & c.rlike(latin if language == "en" else arabic), F.lit(False)
    )


def is_city(c: Column) -> Column:
    t = trim_blanks(c)
    return F.coalesce(F.length(t).between(2, 100) & t.rlike(r"^[a-zA-Z\u00c0-\u017f\s\-']+$"), F.lit(False))


def is_business_type(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin(*fv.BUSINESS_TYPES), F.lit(False))


def is_string_list(c: Column) -> Column:
    """Every element non-blank and at most 200 long."""
    return F.coalesce(F.forall(c, lambda x: has_value(x) & (F.length(x) <= 200)), F.lit(False))


def is_confidence(c: Column) -> Column:
    return F.coalesce(c.between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


# --- validation ----------------------------------------------------------------------------------

_LISTS = [
    "categories", "products", "services", "brands", "locations",
    "secondary_emails", "secondary_phones", "secondary_websites", "secondary_socials",
]


def _messages(rules: list[tuple[Column, Column | str]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(cond, m if isinstance(m, Column) else F.lit(m)) for cond, m in rules])
    )


def validated(df: DataFrame) -> DataFrame:
    """Adds errors, warnings and is_valid by the rules for extracted records."""
    out = with_missing(df, ["name_en", "name_ar", "business_type", "website_url", "phone", "email", *_LISTS])
    if "city" not in out.columns:
        out = out.withColumn("city", F.lit(None).cast("string"))
    c = F.col
    english, arabic = is_name(c("name_en"), "en"), is_name(c("name_ar"), "ar")

    def bad(name: str, good: Column, label: str) -> tuple[Column, Column]:
        return truthy(c(name)) & ~good, F.concat(F.lit(f"{label}: "), c(name))

    errors = [
        (~english & ~arabic, "Company name in English is required and must be valid"),
        (
            truthy(c("business_type")) & ~is_business_type(c("business_type")),
            'Invalid business type. Must be "vendor", "manufacturer", or "trader"',
        ),
        bad("website_url", urls.is_absolute_url(c("website_url")), "Invalid website URL"),
        bad("phone", is_phone(c("phone")), "Invalid phone number"),
        bad("email", is_email(c("email")), "Invalid email"),
        bad("city", is_city(c("city")), "Invalid city name"),
        *[
            (
                c(name).isNotNull() & ~is_string_list(c(name)),
                f"{name.replace('_', ' ').capitalize()} array contains invalid entries",
            )
            for name in _LISTS
        ],
    ]
    warnings = [
        (~english & arabic, "English name is missing; using Arabic company name as fallback"),
        (truthy(c("name_ar")) & ~arabic, "Arabic name provided but appears to be invalid"),
    ]
    return out.withColumns({"errors": _messages(errors), "warnings": _messages(warnings)}).withColumn(
        "is_valid", F.size("errors") == 0
    )


def validated_for_save(df: DataFrame) -> DataFrame:
    """Adds errors, warnings and is_valid by the rules a record must pass before it is stored."""
    out = with_missing(
        df,
        ["name_en", "slug", "business_type", "email", "sales_email", "procurement_email", "website_url", "logo_url",
         "linkedin_url", "phone", "confidence_score", "description_en", "city_id", "region_id"],
    )
    c = F.col

    def malformed(name: str, pattern: str, what: str) -> tuple[Column, Column]:
        return truthy(c(name)) & ~c(name).rlike(pattern), F.format_string(f'{name} has invalid {what} format: "%s"', c(name))

    errors = [
        *[(~has_value(c(n)), f"{n} is required") for n in ("name_en", "slug")],
        (~truthy(c("business_type")), "business_type is required"),
        *[malformed(n, tx.MAIL_SHAPE, "email") for n in ("email", "sales_email", "procurement_email")],
        *[malformed(n, "^(?i:https?)://.+", "URL") for n in ("website_url", "logo_url", "linkedin_url")],
        (
            c("confidence_score").isNotNull() & ~is_confidence(c("confidence_score")),
            F.concat(F.lit("confidence_score out of range: "), c("confidence_score").cast("string")),
        ),
    ]
    clean_phone = F.regexp_replace(c("phone"), r"[\s\-().]", "")
    warnings = [
        (truthy(c("linkedin_url")) & ~c("linkedin_url").contains("linkedin.com"), 'linkedin_url does not contain "linkedin.com"'),
        (truthy(c("phone")) & ~clean_phone.rlike(r"^\+?\d{7,15}$"), F.format_string('phone format looks unusual: "%s"', c("phone"))),
        (truthy(c("description_en")) & (F.length("description_en") < 10), "description_en is very short (< 10 chars)"),
        (~truthy(c("city_id")), "city_id is missing, will use default"),
        (~truthy(c("region_id")), "region_id is missing, will use default"),
    ]
    return out.withColumns({"errors": _messages(errors), "warnings": _messages(warnings)}).withColumn(
        "is_valid", F.size("errors") == 0
    )


def review_queue(invalid: DataFrame, id_col: str, as_of: Column) -> DataFrame:
    """One review row per rejected record."""
    return invalid.select(
        F.sha2(F.concat_ws("|", F.lit("validation"), F.col(id_col).cast("string")), 256).alias("id"),
        F.col(id_col).cast("string").alias("company_id"),
        F.lit("validation_error").alias("item_type"),
        F.array_join("errors", "; ").alias("reason"),
        F.size("errors").alias("error_count"),
        F.lit("pending").alias("status"),
        as_of.alias("created_at"),
    )


def batch_ids(ids: Column) -> Column:
    """Trimmed, distinct ids of a batch request; an error for null, none or more than 100."""
    clean = F.array_distinct(F.filter(F.transform(ids, trim_blanks), lambda x: x != ""))
    ok = ids.isNotNull() & F.size(clean).between(1, 100)
    return F.when(ok, clean).otherwise(F.raise_error(F.lit("a batch takes 1 to 100 company ids")))


# --- confidence clamps -------------------------------------------------------------------------------


def clamped(c: Column) -> Column:
    """The score if it lies in 0..1, else 0."""
    return F.when(is_confidence(c), c).otherwise(0.0)


def clamp_payload(df: DataFrame) -> DataFrame:
    """Clamp confidence_score and field_confidence; ``clamped`` tells whether anything changed."""
    changes, out = F.lit(False), {}
    if "confidence_score" in df.columns:
        s = F.col("confidence_score").try_cast("double")
        out["confidence_score"] = clamped(s)
        changes = changes | ~is_confidence(s)
    if "field_confidence" in df.columns:
        m = F.col("field_confidence")
        out["field_confidence"] = F.transform_values(m, lambda k, x: clamped(x.try_cast("double")))
        changes = changes | F.coalesce(
            F.exists(F.map_values(m), lambda x: ~is_confidence(x.try_cast("double"))), F.lit(False)
        )
    return df.withColumn("clamped", changes).withColumns(out)


def storable(df: DataFrame) -> DataFrame:
    """Payload as it may be stored: clamped, address and city folded into full_address, foreign keys out."""
    out = clamp_payload(df).drop("clamped")
    have = set(out.columns)
    parts = [F.when(truthy(F.col(n)), trim_blanks(F.col(n))) for n in ("address", "city") if n in have]
    if parts:
        joined = F.when(F.coalesce(*[p for p in parts]).isNotNull(), F.concat_ws(", ", *parts))
        given = F.col("full_address") if "full_address" in have else F.lit(None).cast("string")
        out = out.withColumn("full_address", F.coalesce(F.when(truthy(given), given), joined, given))
    return out.drop(*NOT_STORED)


def sanitized(df: DataFrame) -> DataFrame:
    """Scripts out of all texts, schemes on all addresses, address and city into full_address."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out: dict[str, Column] = {}
    for n in ("name_en", "name_ar", "description_en", "description_ar", "phone", "email"):
        if n in have:
            out[n] = F.when(F.col(n) != "", tx.strip_scripts(F.col(n))).otherwise(F.col(n))
    for n in ("website_url", "youtube_url", "tiktok_url"):
        if n in have:
            out[n] = tx.safe_url(F.col(n))
    for n in ("categories", "products", "services", "brands", "locations", "secondary_emails", "secondary_phones"):
        if n in have:
            out[n] = F.transform(F.col(n), tx.strip_scripts)
    for n in ("secondary_websites", "secondary_linkedin", "secondary_socials"):
        if n in have:
            out[n] = F.transform(F.col(n), tx.safe_url)
    if "team_members" in have:
        out["team_members"] = F.transform(
            "team_members",
            lambda m: F.struct(
                tx.strip_scripts(F.coalesce(m["name"], F.lit(""))).alias("name"),
                tx.strip_scripts(F.coalesce(m["role"], F.lit(""))).alias("role"),
            ),
        )
    res = df.withColumns(out)
    if {"name_en", "name_ar"} <= set(have):
        res = res.withColumn(
            "name_en",
            F.when(~has_value(F.col("name_en")) & has_value(F.col("name_ar")), trim_blanks(F.col("name_ar"))).otherwise(
                F.col("name_en")
            ),
        )
    parts = [F.when(truthy(F.col(n)), trim_blanks(F.col(n))) for n in ("address", "city") if n in have]
    if parts:
        given = F.col("full_address") if "full_address" in have else F.lit(None).cast("string")
        joined = F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(", ", *parts))
        res = res.withColumn("full_address", F.coalesce(F.when(truthy(given), given), joined, given))
    return res.drop("address", "city")


# --- shaping ---------------------------------------------------------------------------------------------


def cleaned_candidates(df: DataFrame) -> DataFrame:
    """Extracted candidates: trimmed names, digit phones, lower-case websites, nameless rows dropped."""
    out = with_missing(df, ["name_en", "name_ar", "phone", "website_url"])
    site = trim_blanks(F.col("website_url"))
    full = F.lower(F.when((site != "") & ~site.startswith("http"), F.concat(F.lit("https://"), site)).otherwise(site))
    lists = [n for n in ("categories", "products", "brands", "services") if n in df.columns]
    return out.withColumns(
        {
            "name_en": trim_blanks(F.coalesce("name_en", F.lit(""))),
            "name_ar": trim_blanks(F.coalesce("name_ar", F.lit(""))),
            "phone": tx.phone_digits(F.coalesce("phone", F.lit(""))),
            "website_url": F.when(F.col("website_url") != "", full).otherwise(F.col("website_url")),
            **{n: F.filter(F.transform(n, trim_blanks), lambda x: x != "") for n in lists},
        }
    ).where("name_en <> '' or name_ar <> ''")


def discovered_record(df: DataFrame, as_of: Column) -> DataFrame:
    """A discovered candidate in its stored shape: defaults filled, provenance noted, scores clamped."""
    names = [
        "name_en", "name_ar", "slug", "business_type", "description_en", "description_ar", "categories", "brands",
        "products", "fields", "status", "data_source", "source_url", "confidence_score", "field_confidence", "full_address",
        "city_id", "region_id", "created_at",
    ]
    src = with_missing(df, names)
    for n in ("city", "address"):
        if n not in src.columns:
            src = src.withColumn(n, F.lit(None).cast("string"))
    t = lambda n: F.when(has_value(F.col(n)), trim_blanks(F.col(n)))
    name = F.coalesce(t("name_en"), F.lit("Unknown Company"))
    described = F.coalesce(t("description_en"), name)
    shaped = src.withColumns(
        {
            "_name": name,
            "_described": described,
            "extraction_metadata": F.to_json(
                F.struct(
                    as_of.alias("extracted_at"),
                    F.transform_values(
                        F.coalesce("field_confidence", F.create_map().cast("map<string,double>")),
                        lambda k, x: clamped(x),
                    ).alias("field_confidence"),
                )
            ),
        }
    )
    return shaped.withColumns(
        {
            "name_en": F.col("_name"),
            "name_ar": F.coalesce(t("name_ar"), "_name"),
            "slug": F.coalesce(t("slug"), tx.latin_slug(F.col("_name"))),
            "business_type": first_truthy(F.col("business_type"), F.lit("vendor")),
            "description_en": F.col("_described"),
            "description_ar": F.coalesce(t("description_ar"), "_described"),
            "categories": mapped_categories(F.col("categories")),
            "brands": F.coalesce("brands", F.array().cast("array<string>")),
            "products": tx.clean_items(F.col("products")),
            "fields": tx.clean_items(F.col("fields")),
            "is_verified": F.lit(False),
            "is_featured": F.lit(False),
            "status": first_truthy(F.col("status"), F.lit("pending")),
            "data_source": first_truthy(F.col("data_source"), F.lit("AI Agent")),
            "confidence_score": clamped(F.coalesce("confidence_score", F.lit(0.0))),
            "full_address": F.coalesce(t("full_address"), t("address"), t("city"), F.lit(fv.COUNTRY_NAME)),
            "city_id": first_truthy(F.col("city_id"), F.lit("1")),
            "region_id": first_truthy(F.col("region_id"), F.lit("1")),
            "last_scraped_at": as_of,
            "created_at": F.coalesce("created_at", as_of),
            "updated_at": as_of,
        }
    ).drop("_name", "_described", "city", "address", "field_confidence")


def mapped_categories(items: Column, dimension: list[tuple] = fv.CATEGORIES) -> Column:
    """Category names or ids -> ids; unknown ones kept.  The dimension is a fixed small list."""
    by_id = [c[0] for c in dimension]

    def to_id(x: Column) -> Column:
        out = F.when(x.isin(*by_id), x)
        for cid, en, ar, *_ in dimension:
            out = out.when((F.lower(x) == en.lower()) | (x == ar), cid)
        return out.otherwise(x)

    return F.transform(tx.clean_items(items), to_id)


_LIST_FIELDS = {"categories", "products", "services", "fields", "locations"}


def enrichment_update(payload: Column) -> list[Column]:
    """The allowed fields of an answer (VARIANT), coerced to their types; null where nothing usable came.

    Lists keep their string elements only, members need a name and a role, yes/no
    words become booleans and the score is clamped.
    """
    def strings(path: str) -> Column:
        items = F.try_variant_get(payload, path, "array<variant>")
        kept = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
        return F.transform(kept, lambda x: F.try_variant_get(x, "$", "string"))

    out = []
    for name in fv.ENRICHMENT_FIELDS:
        path = f"$.{name}"
        as_text = F.try_variant_get(payload, path, "string")
        if name == "categories":
            col = F.when(strings(path).isNotNull(), mapped_categories(strings(path)))
        elif name in ("products", "services"):
            col = strings(path)
        elif name in ("fields", "locations"):
            col = F.when(strings(path).isNotNull(), tx.clean_items(strings(path)))
        elif name.startswith("secondary_"):
            col = F.try_variant_get(payload, path, "array<string>")
        elif name == "team_members":
            members = F.try_variant_get(payload, path, "array<variant>")
            text = lambda m, f: F.when(
                F.schema_of_variant(F.try_variant_get(m, f"$.{f}", "variant")) == "STRING",
                F.trim(F.try_variant_get(m, f"$.{f}", "string")),
            )
            pairs = F.transform(members, lambda m: F.struct(text(m, "name").alias("name"), text(m, "role").alias("role")))
            col = F.filter(pairs, lambda p: (p["name"] != "") & (p["role"] != ""))
        elif name == "is_vat_registered":
            word = F.lower(F.trim(as_text))
            col = F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)
        elif name == "confidence_score":
            col = F.when(F.variant_get(payload, path, "variant").isNotNull(), clamped(
                F.when(
                    F.schema_of_variant(F.try_variant_get(payload, path, "variant")) != "STRING",
                    F.try_variant_get(payload, path, "double"),
                )
            ))
        else:
            col = F.when(as_text != "", F.trim(as_text) if name == "full_address" else as_text)
        out.append(col.alias(name))
    return out


# --- scores ----------------------------------------------------------------------------------------------


def data_quality(has: dict[str, Column] | None = None) -> Column:
    """Share of the six field groups that are filled, to two decimals."""
    c = F.col
    groups = [
        truthy(c("name_en")) | truthy(c("name_ar")), truthy(c("website_url")), truthy(c("phone")), truthy(c("email")),
        truthy(c("logo_url")), truthy(c("description_en")) | truthy(c("description_ar")),
    ]
    return F.round(sum((flag(g) for g in groups), F.lit(0)) / 6.0, 2)


def scrape_status() -> Column:
    c = F.col
    named = truthy(c("name_en")) | truthy(c("name_ar"))
    supported = truthy(c("website_url")) | truthy(c("phone")) | truthy(c("email")) | truthy(c("logo_url"))
    return F.when(~named, "failed_parse").when(supported, "success").otherwise("partial")


def rubric_score() -> Column:
    """Confidence 0..1 of a company row: the weights of all signals that hold, in percent points."""
    c = F.col
    any_of = lambda *names: sum_any([has_value(c(n)) for n in names])
    signals = {
        "name_en": has_value(c("name_en")) & ~F.lower(trim_blanks(c("name_en"))).isin(*fv.GENERIC_NAMES),
        "name_ar": has_value(c("name_ar")),
        "description_en": has_value(c("description_en")) & (F.length("description_en") >= 30),
        "description_ar": has_value(c("description_ar")) & (F.length("description_ar") >= 30),
        "business_type": has_value(c("business_type")) & (c("business_type") != "vendor"),
        "any_email": any_of("email", "contact_email", "sales_email", "procurement_email"),
        "phone": has_value(c("phone")),
        "website_url": has_value(c("website_url")),
        "address": has_value(c("full_address"))
        & (F.lower(trim_blanks(c("full_address"))) != fv.COUNTRY_NAME.lower())
        & (F.length(trim_blanks(c("full_address"))) > 15),
        "social": any_of("linkedin_url", "instagram_url", "twitter_url", "facebook_url"),
        "categories": has_items(c("categories")),
        "two_categories": F.coalesce(F.size("categories") >= 2, F.lit(False)),
        "products": has_items(c("products")),
        "brands": has_items(c("brands")),
        "fields": has_items(c("fields")),
        "source_url": has_value(c("source_url")),
        "data_source": has_value(c("data_source")),
        "extraction_metadata": c("extraction_metadata").isNotNull(),
        "last_scraped_at": c("last_scraped_at").isNotNull(),
        "registry": any_of("cr_number", "vat_number"),
    }
    points = sum((F.when(cond, fv.RUBRIC_WEIGHTS[n]).otherwise(0) for n, cond in signals.items()), F.lit(0))
    return F.least(points, F.lit(100)) / 100.0


def sum_any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for x in conds:
        out = out | x
    return out


RUBRIC_COLUMNS = [
    "name_en", "name_ar", "description_en", "description_ar", "business_type", "email", "contact_email", "sales_email",
    "procurement_email", "phone", "website_url", "full_address", "linkedin_url", "instagram_url", "twitter_url",
    "facebook_url", "categories", "products", "brands", "fields", "source_url", "data_source", "extraction_metadata",
    "last_scraped_at", "cr_number", "vat_number",
]


def rescored(df: DataFrame, old: str = "confidence_score") -> DataFrame:
    """Adds ``new_score`` and ``changed`` (moved by more than half a point of a hundred)."""
    out = with_missing(df, RUBRIC_COLUMNS).withColumn("new_score", rubric_score())
    return out.withColumn("changed", F.abs(F.col("new_score") - F.coalesce(old, F.lit(0.0))) > 0.005)


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """Rows per fifth of 0..1, with the overall share of each."""
    bucket = F.least(F.floor(F.col(score) * 5 + 1e-9), F.lit(4)).cast("int")
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean_score"))


COMPLETENESS_COLUMNS = [
    "email", "phone", "website_url", "linkedin_url", "whatsapp", "products", "categories", "description_en", "scope_en",
    "brands", "instagram_url", "twitter_url", "facebook_url", "full_address", "city_id", "region_id", "logo_url",
    "is_verified", "source_url", "name_ar", "description_ar", "seo_title_ar",
]


def completeness(df: DataFrame) -> DataFrame:
    """Adds seven part scores and the overall one (0..100), a grade and advice."""
    out = with_missing(df, COMPLETENESS_COLUMNS)
    types = {f.name: f.dataType for f in out.schema.fields}

    def s(name: str) -> Column:
        c, t = F.col(name), types[name]
        if isinstance(t, T.ArrayType):
            return flag(has_items(c))
        if isinstance(t, T.StringType):
            return flag(has_value(c))
        if isinstance(t, T.BooleanType):
            return flag(c)
        return flag(c.isNotNull())

    def mean(*names: str) -> Column:
        return sum((s(n) for n in names), F.lit(0)) / float(len(names))

    parts = {
        "contact": mean("email", "phone", "website_url", "linkedin_url", "whatsapp"),
        "service": (s("products") * 2 + s("categories") * 2 + s("description_en") + s("scope_en")) / 6.0,
        "brand": s("brands").cast("double"),
        "social": mean("linkedin_url", "instagram_url", "twitter_url", "facebook_url"),
        "location": mean("full_address", "city_id", "region_id"),
        "evidence": mean("logo_url", "is_verified", "source_url"),
        "bilingual": mean("name_ar", "description_ar", "seo_title_ar"),
    }
    out = out.withColumns({f"_{n}": c for n, c in parts.items()})
    out = out.withColumn("_overall", sum((F.col(f"_{n}") for n in parts), F.lit(0.0)) / 7.0)
    advice = [
        (F.col("_contact") < 0.4, "Add contact details"),
        (F.col("_service") < 0.4, "Add product/service descriptions"),
        (F.col("_brand") < 0.5, "Add represented brands"),
        (F.col("_location") < 0.5, "Complete location fields"),
        (F.col("_bilingual") < 0.5, "Add Arabic translations"),
    ]
    o = F.col("_overall")
    return out.withColumns(
        {
            **{f"score_{n}": round_half_up(F.col(f"_{n}") * 100, 0).cast("int") for n in [*parts, "overall"]},
            "grade": F.when(o >= 0.8, "A").when(o >= 0.6, "B").when(o >= 0.4, "C").otherwise("D"),
            "recommendations": _messages(advice),
        }
    ).drop(*[f"_{n}" for n in [*parts, "overall"]])


def quality_audit(df: DataFrame, limit: int = 100, stale_before: Column | None = None) -> DataFrame:
    """Flags on the ``limit`` rows that were updated longest ago."""
    oldest = df.orderBy(F.col("updated_at").asc_nulls_last(), "id").limit(limit)
    low = F.coalesce("confidence_score", F.lit(0.0)) < 0.5
    bare = ~truthy(F.col("description_en")) & ~truthy(F.col("description_ar"))
    stale = F.coalesce(F.col("updated_at") < stale_before, F.lit(False)) if stale_before is not None else F.lit(False)
    return oldest.withColumns(
        {"low_confidence": low, "missing_critical": bare, "outdated": stale, "is_bad": low | bare}
    )


def gap_counts(df: DataFrame) -> DataFrame:
    """One row: total and nine gap counters."""
    c = F.col
    gaps = {
        "missing_logo": ~truthy(c("logo_url")),
        "missing_website": ~truthy(c("website_url")),
        "missing_email": ~truthy(c("email")) & ~truthy(c("contact_email")),
        "missing_phone": ~truthy(c("phone")),
        "missing_description_ar": ~truthy(c("description_ar")),
        "missing_cr_vat": ~truthy(c("cr_number")) & ~truthy(c("vat_number")),
        "low_confidence": c("confidence_score") < 0.5,
        "missing_name_ar": ~truthy(c("name_ar")),
        "name_ar_english": truthy(c("name_ar")) & tx.has_latin(c("name_ar")),
    }
    return df.agg(F.count("*").alias("total"), *[F.count_if(cond).alias(n) for n, cond in gaps.items()])


def short_rubric(valid_categories: list[str]) -> Column:
    """Eight-part score; categories count only when all are known ids."""
    c = F.col
    known = has_items(c("categories")) & F.forall("categories", lambda x: F.lower(x).isin(*valid_categories))
    parts = [
        (truthy(c("name_en")), 20), (truthy(c("description_en")), 10), (truthy(c("description_ar")), 10),
        (truthy(c("logo_url")), 10), (truthy(c("website_url")), 10), (truthy(c("email")) | truthy(c("contact_email")), 10),
        (truthy(c("phone")), 10), (known, 20),
    ]
    return sum((F.when(cond, w).otherwise(0) for cond, w in parts), F.lit(0)) / 100.0


def is_answer_sufficient(kind: str) -> Column:
    """Is an extraction answer worth keeping: named rows, or two of three critical fields filled."""
    c = F.col
    if kind == "discovery":
        return truthy(c("name_en")) | truthy(c("name_ar"))
    long = lambda n: flag(F.length(n) > 10)
    return long("name_en") + long("description_en") + flag(has_items(c("categories"))) >= 2


def website_verdict(body_text: Column, title: Column, meta: Column, redirected: Column, tags: dict[str, Column]) -> Column:
    """struct(is_parked, is_spam, has_company_content, confidence, is_valid) of a stored site page.

    ``tags`` holds booleans nav, footer, contact and about: whether such elements exist.
    """
    low = F.lower(body_text)
    has_any = lambda phrases: low.rlike("|".join(phrases))
    parked, spam, company = has_any(fv.PARKED_PHRASES), has_any(fv.SPAM_PHRASES), has_any(fv.COMPANY_PAGE_WORDS)
    points = (
        50 + 20 * flag(company) + 10 * flag(F.length(title) > 5) + 10 * flag(F.length(meta) > 10) - 10 * flag(redirected)
        + sum((5 * flag(tags[t]) for t in ("nav", "footer", "contact", "about")), F.lit(0))
    )
    score = F.when(parked | spam, 0.1).otherwise(F.least(points, F.lit(100)) / 100.0)
    return F.struct(
        parked.alias("is_parked"), (spam & ~parked).alias("is_spam"),
        (company & ~parked & ~spam).alias("has_company_content"), score.alias("confidence"),
        ((score > 0.4) & ~parked & ~spam).alias("is_valid"),
    )

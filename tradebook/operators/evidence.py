"""Where every value came from: evidence rows, stored pages, raw envelopes, request texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.fixed_values import PREFERRED_EVIDENCE_PAGE
from tradebook.operators.keys import chunked, top_per_key
from tradebook.operators.records import clamped
from tradebook.session import checkpointed


def field_values(companies: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(company_id, field_name, value, confidence): the scored fields of records in long form."""
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    rows = companies.select(F.col(key).alias("company_id"), F.explode("field_confidence").alias("field_name", "_c"), values.alias("_v"))
    return rows.select("company_id", "field_name", F.try_element_at("_v", F.col("field_name")).alias("value"), clamped(F.col("_c")).alias("confidence"))


def preferred_page_type(field: Column) -> Column:
    out = None
    for page_type, fields in PREFERRED_EVIDENCE_PAGE:
        cond = field.isin(*fields)
        out = F.when(cond, page_type) if out is None else out.when(cond, page_type)
    return out


def source_pages_of(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_id and rule: the page of the company that shows a value.

    First a page that holds the snippet, then one that holds the value (four
    characters and more), then one of the type the field is usually found on, then
    the first page.  Values and pages meet on the company, so a company with very
    many pages is a split of the join, not a product of all rows.
    ``values`` has company_id, field_name, value and snippet; ``pages`` company_id,
    page_id, ordinal, page_type and page_text.
    """
    low = pages.select("company_id", "page_id", "ordinal", "page_type", F.lower("page_text").alias("_text"))
    v = values.withColumns(
        {"_snippet": F.lower(F.trim(F.coalesce("snippet", F.lit("")))), "_value": F.lower(F.trim(F.coalesce("value", F.lit(""))))}
    )
    j = v.select("company_id", "field_name", "_snippet", "_value").join(low, "company_id")
    rule = (
        F.when((F.col("_snippet") != "") & F.contains("_text", "_snippet"), 1)
        .when((F.length("_value") >= 4) & F.contains("_text", "_value"), 2)
        .when(F.col("page_type") == preferred_page_type(F.col("field_name")), 3)
        .otherwise(4)
    )
    best = j.select("company_id", "field_name", "page_id", "ordinal", rule.alias("rule")).groupBy("company_id", "field_name").agg(
        F.min(F.struct("rule", "ordinal", "page_id")).alias("_b")
    )
    return values.join(best, ["company_id", "field_name"], "left").withColumns(
        {"page_id": F.col("_b.page_id"), "rule": F.col("_b.rule")}
    ).drop("_b")


def evidence_rows(values: DataFrame, pages: DataFrame, method: str = "ai_suggestion", most_chars: int | None = None) -> DataFrame:
    """Evidence per (company, field): source page, snippet or value, locked from .9 on.

    ``most_chars`` cuts a value that stands in for its snippet; by default it is kept whole.
    """
    placed = source_pages_of(values, pages)
    where = pages.select(F.col("page_id"), F.col("url").alias("source_url"))
    detail = F.coalesce(F.when(F.col("snippet") != "", F.col("snippet")), F.col("value") if most_chars is None else F.substring("value", 1, most_chars))
    return placed.join(where, "page_id", "left").select(
        "company_id", "field_name", "value", "source_url", F.col("page_id").alias("source_page_id"), F.lit(method).alias("extraction_method"),
        detail.alias("extraction_detail"), "confidence", (F.col("confidence") >= 0.9).alias("is_locked"),
    )


LISTED = ["name_en", "name_ar", "website_url", "phone", "email", "city", "address", "description_en"]


def listed_evidence(companies: DataFrame, method: str = "directory_listing", confidence: float = 0.8) -> DataFrame:
    """Evidence of records read from a listing: each filled field with the page the record stands on."""
    fields = [F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in LISTED if c in companies.columns]
    rows = companies.select(
        F.col("id").alias("company_id"), F.explode(F.array(*fields)).alias("_f"), "source_url", F.col("page_id").cast("long").alias("source_page_id")
    )
    return rows.select(
        "company_id", "_f.*", "source_url", "source_page_id", F.lit(method).alias("extraction_method"), F.lit(confidence).alias("confidence")
    ).where(F.trim("value") != "")


def extracted_evidence(candidates: DataFrame) -> DataFrame:
    """Evidence of deterministic extraction: empty and zero-confidence values dropped."""
    return candidates.where((F.trim("value") != "") & (F.col("confidence") > 0)).select(
        F.col("page_id").alias("source_page_id"), F.col("url").alias("source_url"), F.col("field").alias("field_name"), "value",
        F.col("source").alias("extraction_method"), "confidence", (F.col("confidence") >= 0.9).alias("is_locked"),
    )


def contained_passages(passages: DataFrame, texts: DataFrame, words: int = 5) -> DataFrame:
    """(passage_id, text_id) of texts that hold a passage word for word, without meeting all with all.

    A passage that stands in a text brings its inner words along as whole words, so
    the run of ``words`` words after its first one must stand there too: that run
    is the join key, and the whole passage is checked afterwards.  ``passages`` has
    passage_id and passage, ``texts`` text_id and text.  Shorter passages are keyed
    by the one longest run they have, and those without an inner word by their first
    three characters.
    """
    p = passages.withColumn("_w", F.split(F.trim("passage"), r"\s+"))
    inner = F.greatest(F.size("_w") - 2, F.lit(0))
    keyed = p.withColumn("_n", F.least(inner, F.lit(words)).cast("int")).where("_n > 0").withColumn(
        "_run", F.array_join(F.slice("_w", F.lit(2), F.col("_n")), " ")
    )
    # few different run lengths: as many as ``words``
    sizes = keyed.agg(F.sort_array(F.collect_set("_n")).alias("_ns"))
    t = texts.withColumn("_w", F.split(F.trim("text"), r"\s+")).crossJoin(F.broadcast(sizes))
    runs = F.flatten(
        F.transform(
            "_ns",
            lambda n: F.transform(
                F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>")),
                lambda i: F.array_join(F.slice("_w", i, n), " "),
            ),
        )
    )
    opened = t.select("text_id", F.explode(F.array_distinct(runs)).alias("_run"))
    hits = opened.join(keyed.select("passage_id", "passage", "_run"), "_run").select("passage_id", "passage", "text_id")

    brief = p.where((inner == 0) & (F.col("passage") != "")).select("passage_id", "passage", F.substring("passage", 1, 3).alias("_start"))
    lengths = brief.agg(F.sort_array(F.collect_set(F.length("_start"))).alias("_ls"))  # 1, 2 and 3 at most
    starts = F.flatten(
        F.transform(
            "_ls",
            lambda n: F.transform(
                F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1)).otherwise(F.array().cast("array<int>")),
                lambda i: F.substring(F.col("text"), i, n),
            ),
        )
    )
    cut = texts.crossJoin(F.broadcast(lengths)).select("text_id", F.explode(F.array_distinct(starts)).alias("_start"))
    hits = hits.unionByName(cut.join(brief, "_start").select("passage_id", "passage", "text_id")).distinct()
    return hits.join(texts.select("text_id", "text"), "text_id").where(F.contains("text", "passage")).select("passage_id", "text_id")


# --- pages and envelopes ------------------------------------------------------------------------------


def source_page_rows(pages: DataFrame, as_of: Column, status: str = "raw") -> DataFrame:
    """Crawled pages as stored rows: host, size, type, status."""
    return pages.select(
        F.sha2("url", 256).alias("id"), "url", urls.canonical_url(F.col("url")).alias("canonical_url"), urls.host(F.col("url")).alias("domain"),
        F.coalesce("page_type", F.lit("other")).alias("page_type"), F.length("html").alias("html_size_bytes"), F.lit(status).alias("status"),
        as_of.alias("crawled_at"),
    )


def stored_page_ids(pages: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Pages with the id of the first stored row of the same comparable address."""
    first = stored.select(urls.comparable_url(F.coalesce("canonical_url", "url")).alias("_key"), F.col("id").alias("_id"), order).where("_key <> ''")
    ids = checkpointed(first.groupBy("_key").agg(F.min_by("_id", order).alias("stored_id")))
    return pages.withColumn("_key", urls.comparable_url(F.col("url"))).join(ids, "_key", "left").drop("_key")


def raw_envelope(fields: list[str], as_of: Column) -> Column:
    """JSON of what was extracted, from which page and how."""
    return F.to_json(
        F.struct(
            F.struct(*fields).alias("extracted_fields"),
            F.struct(F.col("source_url").alias("url")).alias("source_page"),
            as_of.alias("captured_at"),
        )
    )


def page_bundle(pages: DataFrame, group: str, order: list) -> DataFrame:
    """Pages of a company in order, one row each, with the company's totals beside them.

    Kept as rows: a company may have any number of pages.
    """
    from tradebook.operators.keys import numbered

    placed = numbered(pages, order, [group], "_n")
    totals = checkpointed(
        pages.groupBy(group).agg(F.count("*").alias("total_pages"), F.ceil(F.sum(F.length("html")) / 1024).alias("total_html_kb"))
    )
    return placed.withColumn("page_order", F.col("_n") - 1).drop("_n").join(totals, group)


def request_texts(pages: DataFrame, group: str, order: list, per_request: int = 5, separator: str = "\n\n---\n\n") -> DataFrame:
    """Texts of ``per_request`` consecutive pages joined to one request; whole texts, any number of requests."""
    parts = chunked(pages, order, per_request, [group])
    return parts.groupBy(group, "chunk").agg(
        F.count("*").alias("pages"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), separator).alias("request_text"),
    )


def top_page_text(pages: DataFrame, group: str, order: list, top: int = 6, separator: str = "\n\n---\n\n") -> DataFrame:
    """One labelled text of the best pages of a site."""
    best = top_per_key(pages, [group], order, top)
    label = F.concat(F.lit("["), F.upper("page_type"), F.lit("] "), "url", F.lit("\n"), "text")
    return best.groupBy(group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", label.alias("t")))), lambda x: x["t"]), separator).alias("combined_text")
    )


def label_lookup(labels: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, missing): labels answered by the cache under the md5 of their trimmed lower-case text, and the rest."""
    keyed = labels.withColumn("raw_text_hash", F.md5(F.lower(F.trim("raw_text"))))
    known = keyed.join(cache.select("raw_text_hash", "mapped_id"), "raw_text_hash")
    missing = keyed.join(cache.select("raw_text_hash"), "raw_text_hash", "left_anti").select("raw_text_hash", "raw_text").dropDuplicates(["raw_text_hash"])
    return known, missing


def provider_log(calls: DataFrame, limit: int | None = None) -> DataFrame:
    """Provider calls as log rows, status from the error; ``limit`` cuts long payloads with a marker."""
    cut = lambda n: F.col(n) if limit is None else tx.truncated(F.col(n), limit)
    return calls.withColumns(
        {
            "request_payload": cut("request_payload"), "response_payload": cut("response_payload"),
            "status": F.when(F.col("error_message").isNull(), "success").otherwise("error"),
        }
    )


def suggestions(updates: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """(company_id, field_name, current_value, suggested_value, status): proposals that would change something."""
    def long(df: DataFrame, name: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias(name)) for f in fields]))
        return df.select(F.col("id").alias("company_id"), rows.alias("_r")).select("company_id", "_r.*")

    new = long(updates, "suggested_value").where("suggested_value is not null and suggested_value <> ''")
    old = long(current, "current_value")
    return new.join(old, ["company_id", "field_name"], "left").where(
        ~F.col("suggested_value").eqNullSafe(F.col("current_value"))
    ).withColumn("status", F.lit("pending"))


def junction_rows(companies: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Distinct (company_id, value) of a list column."""
    return (
        companies.select(F.col(key).alias("company_id"), F.explode(column).alias("value"))
        .withColumn("value", F.trim("value")).where("value <> ''").distinct()
    )


def social_rows(companies: DataFrame, key: str = "id") -> DataFrame:
    """(company_id, platform, url) of the social columns."""
    platforms = ["linkedin", "instagram", "twitter", "facebook", "youtube", "tiktok"]
    have = [p for p in platforms if f"{p}_url" in companies.columns]
    entries = F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(f"{p}_url").alias("url")) for p in have]))
    return companies.select(F.col(key).alias("company_id"), entries.alias("_e")).select("company_id", "_e.*").where("url <> ''")


def filter_valid_sites(companies: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, reported): companies whose site was judged valid, and the rest; joined on the site's host."""
    site = urls.domain(F.col("website_url"))
    joined = companies.withColumn("_site", site).join(
        verdicts.select(F.col("domain").alias("_site"), F.col("is_valid").alias("_ok"), F.col("confidence").alias("site_confidence")), "_site", "left"
    ).drop("_site")
    return joined.where(F.coalesce("_ok", F.lit(False))).drop("_ok"), joined.where(~F.coalesce("_ok", F.lit(False))).drop("_ok")

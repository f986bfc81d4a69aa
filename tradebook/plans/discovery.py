"""From parsed pages to stored company rows: extract, clean, match, number, score, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import urls
from tradebook.operators import extract as ex
from tradebook.operators import records as rec
from tradebook.operators import tables as tb
from tradebook.session import checkpointed
from tradebook.sources.schemas import with_missing


@dataclass(frozen=True)
class Discovery:
    """What one run yields."""

    companies: DataFrame
    fallback_pages: DataFrame


def found_records(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of the pages, cleaned and each identity once; all records as extracted)."""
    return _unique(checkpointed(ex.extract_records(parsed, None)))


def _unique(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    # pages are parsed and read once; everything after works on the narrow records
    cleaned = rec.cleaned_candidates(records).withColumns(
        {"_order": F.struct("page_id", "ordinal"), "_rid": F.concat_ws(":", F.col("page_id").cast("string"), F.col("ordinal").cast("string"))}
    )
    return checkpointed(tb.first_per_identity(cleaned, "_order").drop("identity")), records


def placed_records(unique: DataFrame, stored: DataFrame, as_of: Column, taken: DataFrame | None = None) -> DataFrame:
    """Company rows with the id of the stored row they match, or the next one after those of ``taken`` (default ``stored``)."""
    scored = with_missing(_with_ids(unique, stored, stored if taken is None else taken), ["logo_url", "description_ar"])
    return scored.withColumns(
        {
            "data_quality_score": rec.data_quality(), "scrape_status": rec.scrape_status(),
            "source_domain": urls.host(F.col("source_url")), "last_scraped_at": as_of, "last_seen_at": as_of,
            "first_seen_at": F.coalesce("_first", as_of),
            "action": F.when(F.col("_existing").isNull(), "created").otherwise("updated"),
        }
    ).drop("_order", "_rid", "_existing", "_first")


def discover(parsed: DataFrame, stored: DataFrame, as_of: Column, strategies: list[str] | None = None) -> Discovery:
    """Company rows found on the pages, with the id of the stored row they match or a new one.

    ``stored`` has at least id, name_en, name_ar, website_url, source_url and first_seen_at.
    """
    unique, records = _unique(checkpointed(ex.extract_records(parsed, strategies)))
    return Discovery(placed_records(unique, stored, as_of), ex.pages_without_records(parsed, records))


def _with_ids(rows: DataFrame, stored: DataFrame, taken: DataFrame) -> DataFrame:
    keyed = rows.withColumn("id", F.col("_rid"))
    matches = tb.match_existing(keyed, stored, "id").select(F.col("id").alias("_rid"), F.col("existing_id").alias("_existing"))
    firsts = stored.select(F.col("id").alias("_existing"), F.col("first_seen_at").alias("_first"))
    fresh = rows.select("_rid", "page_id", "ordinal").join(matches, "_rid", "left_anti")
    given = tb.reserve_ids(fresh, taken, ["page_id", "ordinal"], "_new").select("_rid", F.col("_new").cast("string").alias("_new"))
    out = rows.join(matches, "_rid", "left").join(firsts, "_existing", "left").join(given, "_rid", "left")
    return out.withColumn("id", F.coalesce("_existing", "_new")).drop("_new")

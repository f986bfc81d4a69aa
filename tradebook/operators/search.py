"""Search table: building it, keeping it in step, querying it one by one or in bulk."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions.semantics import blank_to_null
from tradebook.operators.keys import perhaps_in
from tradebook.operators.tables import delete_rows, upsert
from tradebook.session import written
from tradebook.sources.schemas import with_missing

_TEXTS = ["name_en", "name_ar", "business_type", "description_en", "description_ar", "city"]
_DROPPED = re.compile(r"[^A-Za-z0-9_؀-ۿݐ-ݿ]+")
_LISTS = ["categories", "products", "services", "brands"]


@F.pandas_udf(T.StringType())
def _bare(texts: pd.Series) -> pd.Series:
    """Marks and blanks become single spaces.  Java's expressions take ten times as long for a class with Arabic letters."""
    return pd.Series([None if t is None else _DROPPED.sub(" ", t).strip(" ") for t in texts], dtype=object)


def searchable_text() -> Column:
    """All names, texts and list items of a record: lower case, Latin and Arabic letters, digits and single spaces."""
    joined = F.concat_ws(" | ", *[blank_to_null(F.col(c)) for c in _TEXTS], *[F.col(c) for c in _LISTS])
    return _bare(F.lower(joined))


def index_rows(companies: DataFrame, as_of: Column) -> DataFrame:
    """Search rows of the records that have an id."""
    df = companies if "city" in companies.columns else companies.withColumn("city", F.lit(None).cast("string"))
    df = with_missing(df, [*[t for t in _TEXTS if t != "city"], *_LISTS])
    empty = F.array().cast("array<string>")
    return df.where(blank_to_null(F.col("id").cast("string")).isNotNull()).select(
        "id", *[F.coalesce(c, F.lit("")).alias(c) for c in _TEXTS], *[F.coalesce(F.col(c), empty).alias(c) for c in _LISTS],
        searchable_text().alias("searchable_text"), as_of.alias("last_updated"),
    )


def index_report(companies: DataFrame) -> DataFrame:
    """How many records a rebuild takes in and how many it must refuse."""
    ok = blank_to_null(F.col("id").cast("string")).isNotNull()
    return companies.agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))


def reindex(index: DataFrame, changed: DataFrame, as_of: Column) -> DataFrame:
    return upsert(index, index_rows(changed, as_of), ["id"])


def remove(index: DataFrame, doomed: DataFrame) -> DataFrame:
    return delete_rows(index, doomed, ["id"])


def search(index: DataFrame, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows whose text holds every term of the query as a piece, newest first."""
    terms = [t.lower() for t in text.split()]
    if not terms:
        return index.limit(0)
    found = index
    for t in terms:
        found = found.where(F.contains("searchable_text", F.lit(t)))
    ordered = found.orderBy(F.col("last_updated").desc(), "id")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def _words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))


def postings(index: DataFrame, key: str = "id", text: str = "searchable_text") -> DataFrame:
    """(term, key): distinct words of every row."""
    return index.select(key, F.explode(_words(text)).alias("term"))


def search_many(queries: DataFrame, index: DataFrame, key: str = "id", text: str = "searchable_text") -> DataFrame:
    """(query_id, key) of all rows that hold every word of a query.

    Each query goes to the rows of its rarest word only; its other words are
    counted in those rows.  So a word that half the rows hold is never the one
    that is joined on unless a query has nothing rarer, and of the words of the
    rows only those are moved that some query asks of that row.
    """
    q = queries.select(
        "query_id", F.array_distinct(F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "")).alias("terms")
    ).where(F.size("terms") > 0)
    wanted = q.select(F.explode("terms").alias("term")).distinct()
    # one pass over the texts
    held = written(index.select(key, _words(text).alias("words")), "search-words").select(key, F.explode("words").alias("term"))
    weight = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = (
        q.select("query_id", "terms", F.explode("terms").alias("term")).join(weight, "term", "left")
        .groupBy("query_id").agg(
            F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"), F.first("terms").alias("terms")
        )
    )
    met = held.join(written(rarest, "search-rarest"), "term").select("query_id", key, F.explode("terms").alias("term"), F.size("terms").alias("n"))
    asked = written(met.distinct(), "search-asked")  # rows of one key count as one
    there = perhaps_in(held, asked, [key, "term"]).distinct()
    found = asked.join(there, [key, "term"]).groupBy("query_id", key).agg(F.count("*").alias("_found"), F.first("n").alias("n"))
    return found.where("_found = n").select("query_id", key)

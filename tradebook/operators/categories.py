"""Category and brand dimensions: mapping, keyword fallback, junctions, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import text as tx
from tradebook.operators.keys import ranked_per_key


def mapped(values: DataFrame, dimension: DataFrame, value: str = "value") -> DataFrame:
    """Adds category_id: the dimension's id by id, else by lower-case English name, else the value itself.

    Two equi joins instead of one OR join, so neither becomes a nested loop.
    """
    by_id = dimension.select(F.col("id").alias("_id")).distinct()
    by_name = dimension.groupBy(F.lower("name_en").alias("_name")).agg(F.min("id").alias("_named"))
    out = values.join(by_id, F.col(value) == F.col("_id"), "left").join(
        by_name, F.lower(F.col(value)) == F.col("_name"), "left"
    )
    return out.withColumn("category_id", F.coalesce("_id", "_named", value)).drop("_id", "_name", "_named")


def by_keyword(records: DataFrame, dimension: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, category_id, rank): up to k categories whose name occurs in name or description.

    A category name is a run of letters and digits of the text only where it is
    equal to one of the text's pieces, but 'contains' also finds it inside longer
    words.  Each distinct text is cut into all pieces of the lengths that names
    have, and the pieces are joined to the names by equality; no text meets every
    name.
    """
    names = dimension.select(F.col("id").alias("category_id"), F.lower("name_en").alias("_word")).where("_word <> ''")
    lengths = names.select(F.length("_word").alias("_n")).distinct().agg(F.sort_array(F.collect_set("_n")).alias("_ns"))
    texts = records.select(
        key, F.explode(F.array(F.lower("name_en"), F.lower(F.coalesce("description_en", F.lit(""))))).alias("_text")
    )
    # one row of at most as many numbers as there are different name lengths
    sized = texts.join(F.broadcast(lengths))
    pieces = sized.select(
        key,
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        "_ns",
                        lambda n: F.transform(
                            F.when(
                                F.length("_text") >= n, F.sequence(F.lit(1), F.length("_text") - n + 1)
                            ).otherwise(F.array().cast("array<int>")),
                            lambda i: F.substring(F.col("_text"), i, n),
                        ),
                    )
                )
            )
        ).alias("_word"),
    )
    hits = pieces.join(names, "_word").select(key, "category_id").distinct()
    return ranked_per_key(hits, [key], ["category_id"], k, "rank")


def from_labels(answers: DataFrame, dimension: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, pos, category_id) for the labels of a comma or blank separated answer that are known."""
    labels = answers.select(key, F.posexplode(F.split(F.col(answer), r"[\s,]+")).alias("pos", "_raw"))
    clean = labels.withColumn("value", F.regexp_replace(F.lower(F.trim("_raw")), "^['\"]|['\"]$", "")).where("value <> ''")
    ids = dimension.select(F.lower("id").alias("_id"), F.col("id").alias("_orig")).groupBy("_id").agg(F.min("_orig").alias("_orig"))
    names = dimension.groupBy(F.lower("name_en").alias("_name")).agg(F.min("id").alias("_named"))
    out = clean.join(ids, F.col("value") == F.col("_id"), "left").join(names, F.col("value") == F.col("_name"), "left")
    return out.withColumn("category_id", F.coalesce("_orig", "_named")).where("category_id is not null").select(
        key, "pos", "category_id"
    )


def frequency(df: DataFrame, items: str, top: int) -> DataFrame:
    """The most frequent elements of an array column."""
    return (
        df.select(F.explode(items).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "category").limit(top)
    )


def category_dimension(df: DataFrame, columns: list[str]) -> DataFrame:
    """Dimension rows for the distinct, non-numeric values of the array columns."""
    values = None
    for c in columns:
        part = df.select(F.explode(c).alias("_v"))
        values = part if values is None else values.union(part)
    values = values.where(~F.col("_v").rlike(r"^\d+$") & (F.trim("_v") != "")).distinct()
    slug = F.lower(F.replace("_v", F.lit(" "), F.lit("-")))
    # two spellings may share a slug: the first by text order names it
    return values.groupBy(slug.alias("id")).agg(F.min(tx.title_case(F.col("_v"))).alias("name_en")).withColumn("slug", F.col("id"))


def category_junction(df: DataFrame, key: str, columns: list[str], dimension: DataFrame) -> DataFrame:
    """Distinct (key, category_id): values of the arrays that are an id or a slug of the dimension."""
    both = F.explode(tx.union_keep_order(*[F.col(c) for c in columns]))
    values = df.select(key, both.alias("_v"))
    by_id = values.join(dimension.select(F.col("id").alias("category_id"), F.col("id").alias("_v")), "_v")
    by_slug = values.withColumn("_v", F.lower(F.replace("_v", F.lit(" "), F.lit("-")))).join(
        dimension.select(F.col("id").alias("category_id"), F.col("slug").alias("_v")), "_v"
    )
    return by_id.select(key, "category_id").union(by_slug.select(key, "category_id")).distinct()


def brand_dimension(df: DataFrame, items: Column) -> DataFrame:
    """normalized_name -> the smallest trimmed spelling."""
    raw = df.select(F.explode(items).alias("_b")).select(F.trim("_b").alias("name"), tx.brand_key(F.col("_b")).alias("normalized_name"))
    return raw.where("normalized_name <> ''").groupBy("normalized_name").agg(F.min("name").alias("name")).withColumn(
        "id", F.sha2("normalized_name", 256)
    )


def brand_junction(df: DataFrame, key: str, items: Column, brands: DataFrame) -> DataFrame:
    """Distinct (key, brand_id)."""
    values = df.select(key, F.explode(items).alias("_b")).select(key, tx.brand_key(F.col("_b")).alias("normalized_name"))
    return (
        values.where("normalized_name <> ''").distinct()
        .join(brands.select("normalized_name", F.col("id").alias("brand_id")), "normalized_name")
        .select(key, "brand_id").distinct()
    )


def unused(dimension: DataFrame, junction: DataFrame, id_col: str, ref: str) -> DataFrame:
    """Dimension rows no junction row points to."""
    return dimension.join(junction.select(F.col(ref).alias(id_col)).distinct(), id_col, "left_anti")


def synced_brands(old_brands: DataFrame, old_junction: DataFrame, changed: DataFrame, key: str, items: Column):
    """Brand tables after the rows of ``changed`` were written: (brands, junction).

    New brands are added, the junction rows of the changed records are replaced,
    and brands nobody uses any more go.
    """
    fresh = brand_dimension(changed, items)
    brands = old_brands.select("normalized_name", "name", "id").unionByName(
        fresh.join(old_brands.select("normalized_name"), "normalized_name", "left_anti")
    )
    kept = old_junction.join(changed.select(key).distinct(), key, "left_anti")
    junction = kept.select(key, "brand_id").unionByName(brand_junction(changed, key, items, brands))
    return brands.join(junction.select(F.col("brand_id").alias("id")).distinct(), "id", "left_semi"), junction

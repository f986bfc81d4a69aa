"""Writers: exports, sitemaps, dumps, and versioned tables for upserts on plain files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.operators.keys import numbered

# --- exports ---------------------------------------------------------------------------------------


def export_columns(df: DataFrame, fields: Sequence[str] | None = None, metadata: bool = False) -> list[str]:
    """Chosen columns that the table has; a fresh list every time."""
    wanted = list(fields or fv.EXPORT_FIELDS)
    if metadata:
        wanted += [f for f in fv.EXPORT_METADATA_FIELDS if f not in wanted]
    return [c for c in wanted if c in df.columns]


def export_rows(df: DataFrame, fields: Sequence[str] | None = None, metadata: bool = False, joined: str | None = "; ") -> DataFrame:
    """The chosen columns: addresses canonical, lists joined (or kept), other nested values as JSON."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str) -> Column:
        c, t = F.col(name), types[name]
        if name.endswith("_url") and isinstance(t, T.StringType):
            return F.coalesce(urls.canonical_url(c), c).alias(name)
        if isinstance(t, T.ArrayType) and joined is not None:
            flat = F.array_join(c, joined) if isinstance(t.elementType, T.StringType) else F.to_json(c)
            return flat.alias(name)
        if isinstance(t, (T.MapType, T.StructType)) and joined is not None:
            return F.to_json(c).alias(name)
        return c

    return df.select(*[cell(n) for n in export_columns(df, fields, metadata)])


def write_csv(rows: DataFrame, path: str, bom: bool = True, mode: str = "overwrite") -> None:
    """CSV files with header and doubled quotes; the byte order mark goes before the first header cell of every file."""
    first = rows.columns[0]
    named = rows.withColumnRenamed(first, f"\ufeff{first}") if bom else rows
    named.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def api_payload(df: DataFrame, metadata: bool = False) -> DataFrame:
    """(id, body): nested JSON of every record, as the public interface answers it."""
    c = F.col
    empty = F.array().cast("array<string>")
    text = lambda n: F.coalesce(c(n), F.lit(""))
    none = lambda n: F.when(c(n) != "", c(n))
    parts = [
        c("id"), F.struct(text("name_en").alias("en"), text("name_ar").alias("ar")).alias("name"), c("business_type").alias("type"),
        F.struct(text("description_en").alias("en"), text("description_ar").alias("ar")).alias("description"),
        F.struct(urls.canonical_url(none("website_url")).alias("website"), none("email").alias("email"), none("phone").alias("phone")).alias("contact"),
        F.struct(none("city").alias("city"), F.lit(fv.COUNTRY_NAME).alias("country")).alias("location"),
        F.struct(none("linkedin_url").alias("linkedin")).alias("social"),
        F.coalesce("categories", empty).alias("categories"), F.coalesce("products", empty).alias("products"),
        F.coalesce("is_verified", F.lit(False)).alias("verified"), F.coalesce(none("status"), F.lit("pending")).alias("status"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("confidence"),
    ]
    if metadata:
        parts.append(F.struct(*[m for m in ("source_url", "data_source", "field_confidence", "created_at", "updated_at") if m in df.columns]).alias("metadata"))
    return df.select("id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("body"))


def payload_header(df: DataFrame, as_of: Column, endpoint: str = "/api/companies") -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", as_of.alias("exported_at"), F.lit(endpoint).alias("endpoint"))


# --- sitemaps -----------------------------------------------------------------------------------------


def escape_xml(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def sitemap_entry(loc: Column, alternate: Column | None, language: str, lastmod: Column | None, changefreq: str, priority: float) -> Column:
    """One <url> element as text."""
    parts = [F.lit("  <url>\n    <loc>"), escape_xml(loc), F.lit("</loc>")]
    if alternate is not None:
        parts += [F.lit(f'\n    <xhtml:link rel="alternate" hreflang="{language}" href="'), escape_xml(alternate), F.lit('" />')]
    if lastmod is not None:
        parts.append(F.when(lastmod != "", F.concat(F.lit("\n    <lastmod>"), lastmod, F.lit("</lastmod>"))).otherwise(""))
    parts.append(F.lit(f"\n    <changefreq>{changefreq}</changefreq>\n    <priority>{priority:.1f}</priority>\n  </url>"))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def company_sitemap(companies: DataFrame, base_url: str, part_rows: int = fv.SITEMAP_PART_ROWS) -> DataFrame:
    """(part, pos, id, entry) of the approved companies in id order, ``part_rows`` to a part."""
    slug = F.coalesce(F.when(F.col("slug") != "", F.col("slug")), tx.latin_slug(F.col("name_en")), F.col("id").cast("string"))
    stamp = F.date_format(F.coalesce("updated_at", "created_at"), "yyyy-MM-dd")
    loc = F.concat(F.lit(base_url), tx.company_path(F.col("id"), F.col("_slug"), F.lit("en")))
    other = F.concat(F.lit(base_url), tx.company_path(F.col("id"), F.col("_slug"), F.lit("ar")))
    rows = numbered(companies.where("status = 'approved'").withColumn("_slug", slug), ["id"], (), "_n")
    return rows.select(
        (F.floor((F.col("_n") - 1) / part_rows) + 1).cast("long").alias("part"), ((F.col("_n") - 1) % part_rows + 1).alias("pos"), "id",
        sitemap_entry(loc, other, "ar", stamp, "weekly", 0.6).alias("entry"),
    )


def sitemap_index(companies: DataFrame, base_url: str, part_rows: int = fv.SITEMAP_PART_ROWS) -> DataFrame:
    """(no, loc) of the sitemap files: the two fixed ones, then one per part."""
    n = companies.where("status = 'approved'").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    names = F.concat(
        F.array(F.lit("static"), F.lit("categories")),
        F.when(F.col("parts") > 0, F.transform(F.sequence(F.lit(1), F.greatest("parts", F.lit(1))), lambda i: F.concat(F.lit("companies-"), i.cast("string")))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    rows = n.select(F.posexplode(names).alias("no", "name"))
    return rows.select("no", F.concat(F.lit(f"{base_url}/sitemap-"), "name", F.lit(".xml")).alias("loc"))


def category_sitemap(categories: DataFrame, cities: DataFrame, base_url: str) -> DataFrame:
    """Entries of the category pages in both languages and of the city pages."""
    def both(language: str, other: str) -> DataFrame:
        loc = F.concat(F.lit(base_url), tx.category_path(F.col("slug"), F.lit(language)))
        alt = F.concat(F.lit(base_url), tx.category_path(F.col("slug"), F.lit(other)))
        return categories.select(loc.alias("loc"), sitemap_entry(loc, alt, other, None, "daily", 0.8).alias("entry"))

    place = F.concat(F.lit(base_url), tx.location_path(F.col("slug")))
    return both("en", "ar").unionByName(both("ar", "en")).unionByName(cities.select(place.alias("loc"), sitemap_entry(place, None, "", None, "weekly", 0.7).alias("entry")))


STATIC_PAGES = [("", "daily", 1.0), ("/search", "daily", 0.8), ("/categories", "weekly", 0.7), ("/regions", "weekly", 0.7)]
_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"\n'
    '        xmlns:xhtml="http://www.w3.org/1999/xhtml">'
)


def static_sitemap(spark: SparkSession, base_url: str) -> DataFrame:
    """Entries of the eight fixed pages."""
    out = None
    for path, freq, prio in STATIC_PAGES:
        for lang in ("en", "ar"):
            loc = F.lit(f"{base_url}/{lang}{path}")
            row = spark.range(1).select(loc.alias("loc"), sitemap_entry(loc, None, "", None, freq, prio).alias("entry"))
            out = row if out is None else out.unionByName(row)
    return out


def write_sitemap(entries: DataFrame, path: str) -> None:
    """Text files under part=n, one file a part (a part has a bounded number of rows): head, entries in order, foot."""
    from pyspark.sql import Window

    edge = Window.partitionBy("part")
    last = F.max("pos").over(edge)
    text = F.concat(
        F.when(F.col("pos") == 1, F.lit(_HEAD + "\n")).otherwise(""), "entry", F.when(F.col("pos") == last, F.lit("\n</urlset>")).otherwise("")
    )
    rows = entries.withColumn("value", text).repartition("part").sortWithinPartitions("part", "pos")
    rows.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


# --- tables on plain files --------------------------------------------------------------------------------


def dump_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """JSON dump, one folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def write_version(df: DataFrame, folder: str, version: int, bucket: Sequence[str] = ()) -> str:
    """Writes a whole new version of a table; writing the same version again replaces it.

    Plain files have no transactions, so an upsert never touches the files it
    reads: readers take the newest finished version.
    """
    out = df.repartition(*bucket) if bucket else df
    path = f"{folder}/v={version}"
    out.write.mode("overwrite").parquet(path)
    return path


def latest_version(spark: SparkSession, folder: str) -> tuple[int, DataFrame | None]:
    """Newest finished version (the one with its success mark) and its rows."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return -1, None
    found = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("v=")]
    done = sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    if not done:
        return -1, None
    return done[-1], spark.read.parquet(f"{folder}/v={done[-1]}")


_MAKER = "_made_by"


def _versions(spark: SparkSession, folder: str):
    """Hadoop's file system, and (number, path) of all versions, finished or not."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith("v=")] if fs.exists(base) else []
    return fs, sorted(((int(p.getName()[2:]), p) for p in found), key=lambda x: x[0])


def add_version(df: DataFrame, folder: str, version: int, made_by: str) -> None:
    """Write a new version with the mark of who made it.

    The mark is there before the rows, and the version counts once Spark has set its success mark, so either both are
    there or none.  What a failed attempt left under this number goes first.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/v={version}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        raise ValueError(f"{path.toString()} is finished already")
    fs.delete(path, True)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path, _MAKER))
    out.write(bytearray(made_by.encode()))
    out.close()
    df.write.mode("append").parquet(f"{folder}/v={version}")


def version_makers(spark: SparkSession, folder: str) -> set[str]:
    """Marks of all finished versions."""
    jvm = spark.sparkContext._jvm
    fs, found = _versions(spark, folder)
    marks = set()
    for _, path in found:
        mark = jvm.org.apache.hadoop.fs.Path(path, _MAKER)
        if fs.exists(mark) and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            stream = fs.open(mark)
            marks.add(bytes(stream.readAllBytes()).decode())
            stream.close()
    return marks


def drop_versions(spark: SparkSession, folder: str, upto: int) -> None:
    """Remove the versions numbered ``upto`` and less."""
    fs, found = _versions(spark, folder)
    for number, path in found:
        if number <= upto:
            fs.delete(path, True)

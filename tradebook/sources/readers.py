"""Readers: parquet, JDBC, CSV and JSON, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.sources.schemas import COMPANY

CORRUPT = "_corrupt_record"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def one_row(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(key) == value).limit(1)


def read_jdbc(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, properties: dict[str, str] | None = None
) -> DataFrame:
    """A database table, read by ranges of a numeric column in parallel.

    The driver must be on the class path; no connection is opened before an action.
    """
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {})


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a CSV with header: blank lines skipped, lines that do not fit kept aside with their text.

    Quoted cells may span lines, so a file is read by one task; many files are
    read in parallel.
    """
    text = T.StructType([*[T.StructField(f.name, T.StringType()) for f in schema.fields], T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(text).option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("quote", '"')
        .option("escape", '"').option("columnNameOfCorruptRecord", CORRUPT).option("ignoreLeadingWhiteSpace", True).csv(path)
    )
    filled = F.coalesce(*[F.col(f.name) for f in schema.fields]).isNotNull()
    good = raw.where(F.col(CORRUPT).isNull() & filled)
    return good.select(*[typed_cell(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields]), raw.where(F.col(CORRUPT).isNotNull())


def typed_cell(cell: Column, dtype: T.DataType) -> Column:
    """A text cell as its column's type; what does not fit becomes null, garbage words too."""
    clean = tx.cell_to_text(cell)
    if isinstance(dtype, T.StringType):
        return clean
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):
        return tx.cell_to_array(cell)
    if isinstance(dtype, (T.MapType, T.StructType, T.ArrayType)):
        return F.from_json(clean, dtype)
    if isinstance(dtype, T.TimestampType):
        return tx.lenient_timestamp(clean)
    return clean.try_cast(dtype)


def read_json_table(spark: SparkSession, path: str, schema: T.StructType = COMPANY) -> DataFrame:
    """A JSON array file (or files of JSON lines) of one table."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


# tables in the order in which a restore must read them
RESTORE_ORDER = ["categories", "brands", "companies", "company_categories", "company_brands", "company_contacts", "source_pages", "field_evidence"]


def read_backup(spark: SparkSession, folder: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """The tables of a backup folder in dependency order."""
    return {t: read_json_table(spark, f"{folder}/{t}", schemas[t]) for t in RESTORE_ORDER if t in schemas}


def category_table(spark: SparkSession) -> DataFrame:
    """The fixed category list, seven rows: safe to broadcast."""
    return F.broadcast(spark.createDataFrame(fv.CATEGORIES, "id string, name_en string, name_ar string, slug string"))


def city_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(fv.CITIES, "id string, region_id string, name_en string, name_ar string, slug string"))


def region_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(fv.REGIONS, "id string, name_en string, name_ar string, slug string"))


def captured_json(pages: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, pos, body): the captured JSON responses of each page; ``most`` keeps the first ones."""
    found = F.col("network_json") if most is None else F.slice("network_json", 1, most)
    return pages.select("page_id", F.posexplode(found).alias("pos", "body"))

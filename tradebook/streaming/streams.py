"""Structured Streaming over the same operators.

Results that grow with the input go to versioned folders, one version per
micro-batch; a replayed batch is known by the mark of its version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tradebook.functions import urls
from tradebook.sources.writers import add_version, drop_versions, latest_version, version_makers

Batch = Callable[[DataFrame, int], None]


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None, names: str | None = None
) -> DataFrame:
    """Parquet files of a folder as they arrive.

    ``names`` is a pattern of names in the folder: files that fit it, and all files of the folders that fit it.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if names and not any(c in names for c in "*?[{"):
        names = f"[{names[0]}]{names[1:]}"  # Spark lists a stream's single file only by a pattern
    return reader.parquet(f"{folder}/{names}" if names else folder)


def run_to_end(writer, checkpoint: str) -> StreamingQuery:
    """Work off everything that is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def on_change(stream: DataFrame, result: Callable[[], DataFrame], callback: Callable[[DataFrame], None]):
    """Change subscription: whenever rows arrive, hand over the result of the whole query anew."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            callback(result())

    return stream.writeStream.foreachBatch(batch)


def windowed_metrics(points: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counter, gauge and histogram figures per window; rows later than the watermark are dropped.

    In update mode a window's state goes once the watermark has passed it.  Of points at one time the larger is the last.
    """
    return (
        points.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "metric", "tags_key")
        .agg(
            F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.max_by("value", F.struct("ts", "value")).alias("last"),
        )
        .select(F.col("window.start").alias("window_start"), "metric", "tags_key", "n", "total", "min", "max", "last")
    )


def seed_stream(found: DataFrame, late: str = "1 hour") -> DataFrame:
    """Valid, canonical, tagged seeds, each address once within the watermark; ``found`` has url and ts."""
    seeds = found.where(urls.is_valid_url(F.col("url"))).withColumn("canonical_url", urls.canonical_url(F.col("url")))
    tagged = seeds.withColumn("domain", urls.domain(F.col("url"))).withColumn("tags", urls.seed_tags(F.col("domain")))
    return tagged.withWatermark("ts", late).dropDuplicatesWithinWatermark(["canonical_url"])


def keep_versions(folder: str, change: Callable[[DataFrame, DataFrame | None], DataFrame], keep_last: int | None = 20) -> Batch:
    """Batch step: the version after the newest = change(batch, current table).

    A version carries the stream and the batch that made it.  A batch that some
    version already holds is passed over, so a replay changes nothing; a table that
    was there before, or a stream begun anew, is built upon and never written over.
    The last ``keep_last`` versions stay (None: all).
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        made_by = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or ''}:{batch_id}"
        if made_by in version_makers(spark, folder):
            return
        newest, current = latest_version(spark, folder)
        add_version(change(df, current), folder, newest + 1, made_by)
        if keep_last is not None:
            drop_versions(spark, folder, newest + 1 - keep_last)

    return batch


def upsert_stream(stream: DataFrame, folder: str, change: Callable[[DataFrame, DataFrame | None], DataFrame]):
    """Keep a versioned table in step with a stream."""
    return stream.writeStream.foreachBatch(keep_versions(folder, change))


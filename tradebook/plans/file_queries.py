"""Queries over large files that are read in pieces, script state of pages, functions called by name from SQL and percentiles of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.operators import scripts
from tradebook.operators import tables as tb
from tradebook.plans.page_queries import _PER_PAGE
from tradebook.plans.registry import query, table
from tradebook.session import scratch_folder
from tradebook.sources import large_files
from tradebook.sources import writers as wr
from tradebook.streaming import sketches
from tradebook.streaming import streams as st

_DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@query("csv_in_pieces", "SELECT doc_id, md5(text) AS text_md5, n_chars::BIGINT AS n_chars FROM documents")
def csv_in_pieces(spark, sf_dir):
    """Whole documents, line ends and quotes included, written as CSV files and read in pieces."""
    path = scratch_folder(spark, "large-csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("|"), "text", F.lit("|")).alias("text"), "n_chars")
    wr.write_csv(docs, path, bom=False)
    good, _ = large_files.read_large_csv(spark, path, _DOCUMENT)
    text = F.expr("substring(text, 2, length(text) - 2)")  # marks keep blanks at the ends and empty texts
    return good.select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), "n_chars")


@query("json_in_pieces", "SELECT doc_id, md5(text) AS text_md5, n_chars::BIGINT AS n_chars, source AS origin FROM documents")
def json_in_pieces(spark, sf_dir):
    """Whole documents written as elements of JSON arrays, nested objects too, and read in pieces."""
    path = scratch_folder(spark, "large-json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", F.struct(F.struct("source").alias("of")).alias("origin"))
    lines = docs.select(F.concat(F.to_json(F.struct("*")), F.lit(",")).alias("value"))
    lines.write.text(path)
    schema = T.StructType([*_DOCUMENT.fields, docs.schema["origin"]])
    rows = large_files.read_large_json(spark, path, schema)
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_chars", F.col("origin.of.source").alias("origin"))


@query(
    "script_listing",
    f"""SELECT p_partkey // {_PER_PAGE} AS page_id, p_name AS name_en, p_type || ' {{"}};' AS description_en,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://vendors.example.org/v' || p_partkey ELSE 'https://list.example.org/' || (p_partkey // {_PER_PAGE}) END AS source_url
FROM part WHERE (p_partkey // {_PER_PAGE}) % 4 <> 3""",
)
def script_listing(spark, sf_dir):
    """Vendor listings in the state that a page's script assigns; scripts that compute it give no row."""
    item = "to_json(named_struct('name', p_name, 'details', concat(p_type, ' {\"};'), 'subdomain', if(p_partkey % 2 = 0, concat('v', p_partkey), null)))"
    p = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {_PER_PAGE}").alias("page_id"), "p_partkey", F.expr(item).alias("item"))
    pages = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "item"))).alias("items"))
    state = F.concat(F.lit('{"state": {"list-ssr": {"result": {"data": ['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}}}}"))
    code = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("window.__NUXT__=(function(a){return a}("), state, F.lit("))"))).otherwise(
        F.concat(F.lit("var other = {};\nwindow.__NUXT__ = "), state, F.lit(";start()"))
    )
    html = F.concat(F.lit("<html><body><script>"), code, F.lit("</script></body></html>"))
    pages = pages.select("page_id", F.concat(F.lit("https://list.example.org/"), F.col("page_id").cast("string")).alias("url"), html.alias("html"))
    return scripts.script_listing(pages, "https://vendors.example.org/").select("page_id", "name_en", "description_en", "source_url")


@query(
    "slugify_sql",
    "SELECT p_partkey, trim(regexp_replace(lower(' ' || p_name || ' & شركة ' || p_type || '!'), '[^a-z0-9؀-ۿ]+', '-', 'g'), '-') AS slug FROM part",
)
def slugify_sql(spark, sf_dir):
    """Slugs by the function that SQL calls by its name."""
    scripts.register(spark)
    return spark.sql("SELECT p_partkey, slugify(concat(' ', p_name, ' & شركة ', p_type, '!')) AS slug FROM {part}", part=table(spark, sf_dir, "part"))


def _below(value, bound):
    return F.count_if(value < bound)


def _upto(value, bound):
    return F.count_if(value <= bound)


@query(
    "stream_percentiles",
    """SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, true AS p50_near, true AS p90_near, true AS p99_near
FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def stream_percentiles(spark, sf_dir):
    """Percentiles of an event stream by sketches of its hours, merged: each within a hundredth of its rank among all values."""
    events = table(spark, sf_dir, "events")
    points = st.file_stream(spark, sf_dir, events.schema, names="events.parquet").select(
        F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"), F.lit("{}").alias("tags_key")
    )
    folder = scratch_folder(spark, "stream-percentiles")
    key = ["window_start", "metric", "tags_key"]
    change = lambda batch, current: batch if current is None else tb.upsert(current, batch, key)
    st.run_to_end(sketches.windowed_sketches(points).writeStream.outputMode("update").foreachBatch(st.keep_versions(f"{folder}/table", change)), f"{folder}/checkpoint")
    found = sketches.merged(wr.latest_version(spark, f"{folder}/table")[1], ["metric"])
    values = events.select(F.col("event_type").alias("metric"), F.col("value").cast("double").alias("value"))
    ranks = values.join(F.broadcast(found), "metric").groupBy("metric").agg(  # a row a kind of event
        *[F.any_value(c).alias(c) for c in ("n", "mean", "min", "max")],
        *[f(F.col("value"), F.col(p)).alias(f"{p}_{k}") for p in ("p50", "p90", "p99") for k, f in (("below", _below), ("upto", _upto))],
    )
    near = lambda p, q: ((F.col(f"{p}_below") <= (q + 0.01) * F.col("n")) & (F.col(f"{p}_upto") >= (q - 0.01) * F.col("n"))).alias(f"{p}_near")
    return ranks.select("metric", "n", F.round("mean", 6).alias("mean"), "min", "max", near("p50", 0.5), near("p90", 0.9), near("p99", 0.99))

"""Keys of all records meet by shuffles, however small Spark takes the exploded rows to be."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.operators import tables as tb


def test_match_existing_sends_no_keys_to_the_driver(spark):
    make = lambda n, up: spark.range(n).select(
        F.concat(F.lit(up), F.col("id").cast("string")).alias("id"), F.concat(F.lit("Firm number "), F.col("id")).alias("name_en"),
        F.lit("").alias("name_ar"), F.lit("").alias("website_url"), F.lit("").alias("source_url"),
    )
    found = tb.match_existing(make(30, "n"), make(20, "s"), "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    assert {tuple(r) for r in found.collect()} == {(f"n{k}", f"s{k}", 3) for k in range(20)}

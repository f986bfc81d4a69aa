"""Unique slugs: counted per base, beside stored ones, or by an id tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.operators.keys import numbered


def unique_slugs(df: DataFrame, base: str, order: list) -> DataFrame:
    """Adds ``slug``: the first row of a base keeps it, the n-th gets base-(n-1).

    Numbers that would meet another row's base are skipped by
    ``slugs_against_stored``, which treats all bases as taken.
    """
    placed = numbered(df, order, [base], "_n")
    free = _skip_taken(placed, df.select(F.col(base).alias("slug")).distinct(), base, F.col("_n") - 1)
    return free


def slugs_against_stored(new: DataFrame, stored: DataFrame, base: str, order: list) -> DataFrame:
    """Slugs for new rows that clash neither with ``stored`` (column slug) nor with one another."""
    used = stored.select("slug").distinct()
    occupied = used.withColumnRenamed("slug", base).withColumn("_base_taken", F.lit(1))
    placed = numbered(new, order, [base], "_n").join(occupied, base, "left")
    step = F.when(F.col("_base_taken") == 1, F.col("_n")).otherwise(F.col("_n") - 1)
    every = used.union(new.select(F.col(base).alias("slug"))).distinct()
    return _skip_taken(placed, every, base, step).drop("_base_taken")


def _skip_taken(placed: DataFrame, taken: DataFrame, base: str, wish: Column) -> DataFrame:
    """Give the wish-th free number of the base; 0 stands for the bare base.

    The numbers taken under a base are read off the taken slugs, so no loop is
    needed: with taken numbers t_1 < t_2 < ..., the k-th free one is k plus the
    count of i with t_i - i < k, i counted from 0 and t from 1.
    """
    tail = taken.select(
        F.regexp_extract("slug", r"^(.*)-([1-9]\d{0,8})$", 1).alias("_b"),
        F.regexp_extract("slug", r"^(.*)-([1-9]\d{0,8})$", 2).try_cast("long").alias("_t"),
    ).where("_t is not null")
    bases = placed.select(F.col(base).alias("_b")).distinct()
    ranked = numbered(tail.join(bases, "_b", "left_semi"), ["_t"], ["_b"], "_i")
    # k-th free number = k + number of taken with t - (i - 1) <= k
    gaps = ranked.withColumn("_gap", F.col("_t") - F.col("_i") + 1)
    wished = placed.withColumn("_k", wish)
    # runs of taken numbers with the same gap collapse to one row each
    steps = gaps.groupBy("_b", "_gap").agg(F.max("_i").alias("_upto"))
    shift = (
        wished.where("_k > 0")
        .select(F.col(base).alias("_b"), "_k")
        .distinct()
        .join(steps, "_b")
        .where("_gap <= _k")
        .groupBy("_b", "_k")
        .agg(F.max("_upto").alias("_shift"))
    )
    out = wished.join(
        shift.withColumnsRenamed({"_b": "_sb", "_k": "_sk"}),
        (F.col(base) == F.col("_sb")) & (F.col("_k") == F.col("_sk")),
        "left",
    )
    number = F.col("_k") + F.coalesce("_shift", F.lit(0))
    slug = F.when(F.col("_k") == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), number.cast("string")))
    return out.withColumn("slug", slug).drop("_n", "_k", "_sb", "_sk", "_shift")


def slug_or_id_tail(df: DataFrame, base: str, id_col: str, tail: int = 4) -> DataFrame:
    """Where several rows share a base, the first characters of the id are added."""
    shared = df.groupBy(base).agg(F.count("*").alias("_c")).where("_c > 1").select(base, F.lit(1).alias("_shared"))
    out = df.join(shared, base, "left")
    slug = F.when(
        F.col("_shared") == 1, F.concat(F.col(base), F.lit("-"), F.substring(F.col(id_col).cast("string"), 1, tail))
    ).otherwise(F.col(base))
    return out.withColumn("slug", slug).drop("_shared")

"""Mixing sources to target weights by weighted random keys (Efraimidis and Spirakis).

Every document gets the key ``-ln(u) / quality`` with ``u`` made of its id, so a
better document tends to a smaller key and a rerun gives the same keys.  The
documents of a source stand in the order of their keys.  A source whose target
is ``e`` times its size and a rest gives ``e`` complete epochs, and of the rest
the first documents in key order up to the budget.

A source may hold any share of all rows: sizes are added up per (source, slice
of the key range), the slice at which the budget ends is found from those sums,
and only the documents of that one slice are put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook.llm.common import BLANKS, hash_share, n_words_of, stored
from tradebook.operators.keys import numbered

MOST_EPOCHS = 3


def quality_weight(text: Column) -> Column:
    """Share of letters and digits among the characters of the words, at least 0.05; an empty text has 1."""
    bare = F.translate(F.coalesce(text, F.lit("")), BLANKS, "")
    n = F.length(bare)
    good = F.length(F.regexp_replace(bare, "[^\\p{L}\\p{N}]", ""))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(good / n, F.lit(0.05)))


def targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; the targets share the sum of all sizes in these
    proportions, except that none is above ``most`` times its source's size: what is over goes to the others by weight,
    until none is above.  The level is found in rounds of one grouped sum each; a source that has met its bound stays
    there, so the rounds end.
    """
    order = [F.col("source").isNull(), "source"]
    weighed = stored(
        numbered(sizes, order, name="_n").select("source", "source_size", ((F.col("_n") - 1) % 3 + 1).alias("_w")), "mix-sources"
    )
    bound = F.lit(most) * F.col("source_size")
    level, total = 0.0, None
    while True:
        full = bound < F.lit(level) * F.col("_w")
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, bound).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("_w"))).alias("free"),
        ).first()
        total = row["all"] or 0
        above = (total - row["held"]) / row["free"] if row["free"] else level
        if above == level:
            break
        level = above
    target = F.least(bound.cast("double"), F.lit(float(level)) * F.col("_w"))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None,
    most: int = MOST_EPOCHS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies): what the mix takes of each document.

    ``size`` is the number of words of the whole text (null and empty texts: 0, never taken), ``quality`` a positive
    Column (default ``quality_weight``).  ``taken`` counts words: every complete epoch gives the whole document, the
    document at which the budget ends gives what is still missing, so a source meets its target to the word.  ``copies``
    is for a mix of whole documents: the last one is in if the budget reaches its middle.

    Ties of keys stand in the order of ids; rows that repeat an id and a size share their fate except at the border,
    where the order of their rows decides.  A null id takes the key of the empty text; a null source is a source.  An
    empty table gives an empty table.
    """
    key = -F.ln(hash_share(F.col(doc_id)))
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            n_words_of(F.col(text)).alias("size"),
            (key / (quality if quality is not None else quality_weight(F.col(text)))).alias("_key"),
        ),
        "mix-rows",
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(per_source, most).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))

    # as many slices as documents in a slice; the result doesn't depend on it
    slices = max(1, math.isqrt(rows.count()))
    # 1 - e^-key runs evenly over (0, 1) for quality 1 and grows with the key for any
    sliced = rows.withColumn("_slice", F.floor((1 - F.exp(-F.col("_key"))) * slices).cast("int"))
    sums = sliced.groupBy("source", "_slice").agg(F.sum("size").alias("_s"))
    upto = Window.partitionBy("source").orderBy("_slice")
    ends = sums.select("source", "_slice", "_s", (F.sum("_s").over(upto) - F.col("_s")).alias("_before"))
    # the slice in which the budget ends: the last one that begins below it
    border = (
        ends.join(aims.select(F.col("source").alias("_src"), "_rest"), F.col("source").eqNullSafe(F.col("_src")))
        .where(F.col("_before") <= F.col("_rest"))
        .groupBy("source").agg(F.max_by(F.struct("_slice", "_before"), "_slice").alias("_b"))
    )
    plan = stored(
        aims.withColumnRenamed("source", "_src")
        .join(border, F.col("_src").eqNullSafe(F.col("source")), "left")
        .select("_src", "source_size", "target", "_epochs", "_rest",
                F.col("_b._slice").alias("_border"), F.col("_b._before").alias("_before")),
        "mix-plan",
    )
    placed = sliced.join(plan, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    at_border = F.col("_slice") == F.col("_border")
    running = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.col("_before") + F.sum("size").over(running) - F.col("size")
    inside = placed.where(at_border).withColumn("_start", begins).withColumns(
        {
            "_part": F.greatest(F.lit(0), F.least(F.col("size"), F.floor("_rest") - F.col("_start"))).cast("long"),
            "_more": (F.col("_start") + F.col("size") / 2 <= F.col("_rest")).cast("long"),
        }
    ).drop("_start")
    before = F.coalesce(F.col("_slice") < F.col("_border"), F.lit(False)).cast("long")
    clear = placed.where(~F.coalesce(at_border, F.lit(False))).withColumns({"_part": before * F.col("size"), "_more": before})
    return clear.unionByName(inside).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_epochs") * F.col("size") + F.col("_part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("_epochs") + F.col("_more")).otherwise(0).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` with all their columns, each as many times as the mix takes it whole.

    Rows equal in id, source and size share one verdict.
    """
    taken = (
        mix(docs, doc_id, text, source).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("_copies")).where("_copies > 0")
        .select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_copies")
    )
    same = (
        F.col(doc_id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")) & (n_words_of(F.col(text)) == F.col("_size"))
    )
    return docs.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
        *[docs[c] for c in docs.columns]
    )

"""One row per key, and numbering of rows that never puts a whole group into one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook.session import checkpointed

ColumnOrName = Column | str

_BITS = 27  # of the map of ``perhaps_in``; too small a map costs work, never a row


def _cols(names: Sequence[ColumnOrName]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def top_per_key(df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName], k: int = 1) -> DataFrame:
    """The first k rows of every key.

    A filter on row_number is limited per key before the shuffle (the plan shows
    a partial WindowGroupLimit), so a key that holds a third of the table sends
    at most k rows per input partition.
    """
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def ranked_per_key(
    df: DataFrame, keys: Sequence[ColumnOrName], order: Sequence[ColumnOrName], k: int, name: str
) -> DataFrame:
    """As ``top_per_key`` with the rank kept."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def numbered(
    df: DataFrame,
    order: Sequence[ColumnOrName],
    group: Sequence[str] = (),
    name: str = "rn",
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """row_number (and running sums) over (partition by group order by order), for groups of any size.

    Rows are range-partitioned by group and order, so a large group is spread
    over several partitions; each partition numbers its own rows and adds what
    the earlier partitions of the same group hold.  At most one group crosses
    each partition border, so the offsets that matter are fewer than the
    partitions and can be broadcast.  ``order`` must be total for a stable result.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = list(group)
    sums = sums or {}
    by = _cols([*group, *order])
    valued = df.withColumns({f"_v_{n}": c for n, c in sums.items()}) if sums else df
    placed = checkpointed(
        valued.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))

    totals = placed.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part",
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.sum("_n").over(earlier).alias("_before"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_before_{n}") for n in sums],
    ).where(F.col("_before").isNotNull())

    if group or sums:
        within = Window.partitionBy("_part", *group).orderBy("_at")
        local = placed.withColumns(
            {
                "_i": F.row_number().over(within),
                **{f"_r_{n}": F.sum(f"_v_{n}").over(within.rowsBetween(Window.unboundedPreceding, 0)) for n in sums},
            }
        )
    else:
        local = placed.withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)

    joined = local.join(
        F.broadcast(offsets.withColumnRenamed("_part", "_opart")),
        (F.col("_part") == F.col("_opart")) & _all([F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]),
        "left",
    )
    return joined.select(
        *df.columns,
        (F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long").alias(name),
        *[(F.col(f"_r_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in sums],
    )


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def chunked(df: DataFrame, order: Sequence[ColumnOrName], size: int, group: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of ``size`` rows: adds ``chunk`` (from 0) and ``pos`` (from 1)."""
    out = numbered(df, order, group, "_rn")
    return out.withColumns(
        {
            "chunk": F.floor((F.col("_rn") - 1) / size).cast("long"),
            "pos": ((F.col("_rn") - 1) % size + 1).cast("long"),
        }
    ).drop("_rn")


def perhaps_in(df: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose ``by`` columns, all of ``other``'s types, stand in ``other``, and a few more by chance.

    Before a join of a large table with the few rows of it that are asked for: a map of bits goes to every task, so what
    is not asked for is never moved.
    """
    bit = F.pmod(F.xxhash64(*by), F.lit(1 << _BITS)).alias("_bit")
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    pieces = other.select(bit).groupBy(F.expr("_bit div 32768").alias("piece"))
    for r in pieces.agg(F.expr("bitmap_construct_agg(_bit % 32768)").alias("bits")).toLocalIterator():
        bits[r["piece"] << 12 : (r["piece"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            there = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            if there.any():
                yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(there))

    return df.select("*", bit).mapInArrow(work, df.schema)

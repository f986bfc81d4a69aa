"""Two versions of a table compared, and pages of a list by the place of the last row."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): 'added', 'changed' or 'gone' for the keys whose rows differ between two versions.

    Only keys and a SHA-256 of the other columns (in the order of ``new``) meet in the join.  Columns that only one version
    has make every row changed.  A key that repeats counts by the set of its rows.
    """
    def digest(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        rest = [c for c in new.columns if c in rest] + sorted(c for c in rest if c not in new.columns)
        # JSON tells a null from an empty string and one column from the next
        row = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit(""), 256)
        return df.select(*keys, row.alias("_h")).groupBy(*keys).agg(F.array_sort(F.collect_set("_h")).alias("_h"))

    a = digest(old).select(*[F.col(k).alias(f"_old_{k}") for k in keys], F.col("_h").alias("_was"))
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_old_{k}"))
    j = a.join(digest(new), both, "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_h").isNull(), "gone").when(F.col("_was") != F.col("_h"), "changed")
    return j.select(*[F.coalesce(k, f"_old_{k}").alias(k) for k in keys], change.alias("change")).where("change is not null")


Order = Sequence[tuple[str, bool]]  # (column, descending), the last ones making it total


def _sorted(column: str, descending: bool) -> Column:
    return F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()


def cursor_of(row, order: Order) -> str:
    """An opaque mark of the place of a row in the order; values travel as JSON text."""
    values = [None if row[c] is None else row[c] if isinstance(row[c], (int, float, str, bool)) else str(row[c]) for c, _ in order]
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def _beyond(df: DataFrame, order: Order, values: list) -> Column:
    """Rows after the place: a later value in some column and equal values before it; nulls stand last."""
    kinds = dict(df.dtypes)
    out, equal = F.lit(False), F.lit(True)
    for (c, descending), value in zip(order, values, strict=True):
        v = F.lit(value).cast(kinds[c])
        if value is None:
            later = F.lit(False)
        else:
            later = F.col(c).isNull() | (F.col(c) < v if descending else F.col(c) > v)
        out = out | (equal & F.coalesce(later, F.lit(False)))
        equal = equal & F.col(c).eqNullSafe(v)
    return out


def page_after(df: DataFrame, order: Order, size: int, cursor: str | None = None) -> DataFrame:
    """The ``size`` rows after the cursor (None: the first ones), in order.

    A row comparison instead of an offset: what stands before the place is filtered out at the scan, each task sends at most
    ``size`` rows, and rows that come or go elsewhere shift nothing.  Together the columns of ``order`` must be unique.
    """
    rows = df if cursor is None else df.where(_beyond(df, order, json.loads(base64.urlsafe_b64decode(cursor))))
    return rows.orderBy(*[_sorted(c, d) for c, d in order]).limit(size)


def next_cursor(page: Sequence, order: Order, size: int) -> str | None:
    """Cursor after the collected rows of a page; None where there are no more."""
    return cursor_of(page[-1], order) if len(page) == size else None

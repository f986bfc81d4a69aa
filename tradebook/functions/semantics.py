"""Truth, blank and rounding rules the record rules are written against.

The directory's rules treat null, the empty string, zero, NaN and false as
"not there" (``truthy``) and, where a rule trims first, blanks as well
(``has_value``).  Every operator says which of the two it uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All Unicode blanks a web form may hold; Java's \s alone is ASCII only.
BLANKS = r"\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once per row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, which is worked out once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def once(df: DataFrame, *cols: Column) -> DataFrame:
    """Adds the columns, worked out once per row: a condition set on them later isn't pushed below, where it would repeat their work."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def sql_on(column: Column, name: str, body: str) -> Column:
    """Expression written as SQL text over one column, under the given name.

    Long expressions are quicker to hand over as one text than node by node.
    """
    return F.get(F.call_function("transform", F.array(column), F.expr(f"{name} -> {body}")), F.lit(0))


def trim_blanks(c: Column) -> Column:
    """Strip every kind of Unicode blank from both ends."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks become one space; ends are kept."""
    return F.regexp_replace(c, f"[{BLANKS}]+", " ")


def squeeze(c: Column) -> Column:
    """Collapse blanks, then trim: the usual one-line form of a text."""
    return F.trim(collapse_blanks(c))


def truthy(c: Column, dtype: T.DataType | None = None) -> Column:
    """True unless null, '', 0, NaN or false.  Arrays, maps and structs are true when not null."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce((c != 0) & ~F.isnan(c), F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def json_truthy(doc: Column, path: str) -> Column:
    """``truthy`` of a value inside a variant: missing, null, '', 0 and false are not there, lists and objects are."""
    def by_kind(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return (
            F.when(v.isNull() | (kind == "VOID"), False)
            .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(kind.rlike("^(ARRAY|OBJECT)"), True)
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True)))
        )

    return let(F.try_variant_get(doc, path, "variant"), by_kind)


def has_value(c: Column) -> Column:
    """True for a string that holds anything but blanks."""
    return F.coalesce(trim_blanks(c) != "", F.lit(False))


def has_items(c: Column) -> Column:
    """True for an array with at least one element."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def blank_to_null(c: Column) -> Column:
    """'' becomes null, anything else is kept."""
    return F.when(c != "", c)


def first_truthy(*cols: Column) -> Column:
    """The first non-empty string, as ``a || b || c`` picks it."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def round_half_up(c: Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d on doubles."""
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / F.lit(scale)


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp with or without zone."""
    return F.unix_millis(ts.cast("timestamp"))


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or null."""
    return F.when(cond, 1).otherwise(0)


def sorted_percentile(sorted_values: Column, p: float) -> Column:
    """Element floor(n * p) (0-based) of an ascending array."""
    return F.element_at(sorted_values, (F.floor(F.size(sorted_values) * F.lit(p)) + 1).cast("int"))

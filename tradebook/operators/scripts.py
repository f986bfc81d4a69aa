"""Values that page scripts assign, as a table function for SQL, and the listing it serves; SQL functions by name.

A script is never run.  What is assigned must be plain JSON; its end is found by reading it, so braces and quotes inside
strings do not matter.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tradebook.functions import text as tx

# the function travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING_STATE, LISTING_PATH = "__NUXT__", "state.list-ssr.result.data"
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.I | re.S)
# a statement ends at a semicolon, a comma, the end of the script or a line after which no operator goes on with it
_STATEMENT_END = re.compile(r"\s*(?:[;,]|\Z)|[ \t\r]*\n\s*(?![-.\[(+*/%&|?:=<>^`])")


def _refused(word: str):
    raise ValueError(f"{word} is no JSON")


def assigned_values(html: str | None, variable: str) -> Iterator[object]:
    """The JSON values that scripts of a page assign to ``variable`` or ``window.variable``, in page order."""
    decoder = json.JSONDecoder(parse_constant=_refused)
    assignment = re.compile(rf"(?<![\w$.])(?:window\s*\.\s*)?{re.escape(variable)}\s*=(?!=)\s*")
    for script in _SCRIPT.finditer(html or ""):
        code = script.group(1)
        for m in assignment.finditer(code):
            try:
                value, end = decoder.raw_decode(code, m.end())
            except (ValueError, RecursionError):
                continue
            if _STATEMENT_END.match(code, end):
                yield value


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


class ScriptItems:
    """script_items(html, variable, path, fields): (ordinal, one text column per field) of the objects in an array.

    ``path`` leads from the first value assigned to ``variable`` that has it to the array, ``fields`` are names with commas
    between; both are constants, so that the columns are known before any page is read.  Items that are no objects give
    no row.  Numbers, objects and arrays come as JSON text.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, variable: AnalyzeArgument, path: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not all(a.isConstantExpression and a.value for a in (variable, path, fields)):
            raise ValueError("variable, path and fields must be constants that are not empty")
        columns = [T.StructField(f.strip(), T.StringType()) for f in fields.value.split(",")]
        return AnalyzeResult(T.StructType([T.StructField("ordinal", T.IntegerType()), *columns]))

    def eval(self, html, variable, path, fields):
        names = [f.strip() for f in fields.split(",")]
        for value in assigned_values(html, variable):
            for step in path.split("."):
                value = value.get(step) if isinstance(value, dict) else None
            if isinstance(value, list):
                for k, item in enumerate(value):
                    if isinstance(item, dict):
                        yield (k, *(_text(item.get(n)) for n in names))
                return


def register(spark: SparkSession) -> None:
    """Make the functions callable from ``spark.sql``: script_items (a table function) and slugify."""
    spark.udtf.register("script_items", F.udtf(ScriptItems, useArrow=True))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION slugify(name STRING) RETURNS STRING "
        "RETURN trim(BOTH '-' FROM regexp_replace(lower(name), '[^a-z0-9؀-ۿ]+', '-'))"
    )


def script_listing(pages: DataFrame, profile_prefix: str, variable: str = LISTING_STATE, path: str = LISTING_PATH) -> DataFrame:
    """Vendors of listing pages whose script state is plain JSON; ``pages`` has page_id, url and html."""
    spark = pages.sparkSession
    register(spark)
    rows = spark.sql(
        "SELECT p.page_id, p.url, s.* FROM {pages} p, LATERAL script_items(p.html, {variable}, {path}, 'name,details,address,image,subdomain') s",
        pages=pages.select("page_id", "url", "html"), variable=variable, path=path,
    )
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = rows.select(
        "page_id", "ordinal", tx.display_name(given("name")).alias("name_en"), given("details").alias("description_en"), given("address").alias("full_address"),
        given("image").alias("logo_url"), F.coalesce(F.concat(F.lit(profile_prefix), given("subdomain")), "url").alias("source_url"),
        F.lit(0.75).alias("confidence_score"),
    )
    return out.where(F.length("name_en") > 1)

"""Values set at a path of a JSON text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = "map<string,variant>"


def json_set(doc: Column, path: Sequence[str], value: Column) -> Column:
    """JSON text of ``doc`` with ``value`` (a VARIANT) at the path of field names; the other fields stay as they are.

    Parents that are missing or no objects are made, also where ``doc`` is null or no JSON.
    """
    def put(node: Column, names: Sequence[str]) -> Column:
        fields = F.coalesce(F.try_variant_get(node, "$", _FIELDS), F.create_map().cast(_FIELDS))
        head = F.lit(names[0])
        inner = value if len(names) == 1 else F.to_variant_object(put(F.element_at(fields, head), names[1:]))
        return F.map_concat(F.map_filter(fields, lambda k, _: k != head), F.create_map(head, inner))

    if not path:
        raise ValueError("a path names one field at least")
    return F.to_json(put(F.try_parse_json(doc), path))

"""Semi-structured values as VARIANT columns: types, keys, paths, merging and containment.

Two kinds of nothing are kept apart: a null column (no value) and a JSON null (a value).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType


def parse(text: Column) -> Column:
    """The VARIANT of a JSON text; null for null and for what isn't JSON."""
    return F.try_parse_json(text)


def type_of(value: Column) -> Column:
    """object, array, string, number, boolean or null of a VARIANT; null for no value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """What stands at ``path`` (``$.a.b[0]``); null if there is nothing, or nothing of that kind."""
    return F.try_variant_get(value, path, kind)


def entries(value: Column) -> Column:
    """An object's entries as a map to VARIANT; null for other values."""
    return F.when(type_of(value) == "object", F.try_variant_get(value, "$", "map<string,variant>"))


def has_key(value: Column, key: Column) -> Column:
    """Whether an object has the key, or an array the string; false for other values, null for no value."""
    in_array = F.array_contains(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.when(type_of(v) == "string", F.try_variant_get(v, "$", "string"))), key)
    return F.when(value.isNull(), F.lit(None)).otherwise(F.when(type_of(value) == "object", F.map_contains_key(entries(value), key)).when(type_of(value) == "array", F.coalesce(in_array, F.lit(False))).otherwise(False))


def merged(left: Column, right: Column) -> Column:
    """Two objects as one, in which the right one's entries replace the left one's, at the top level; JSON text, null unless both are objects."""
    a, b = entries(left), entries(right)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


@pandas_udf(BooleanType())
def _contains(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def holds(a, b, top: bool = True) -> bool:
        if isinstance(b, dict):
            return isinstance(a, dict) and all(k in a and holds(a[k], v, False) for k, v in b.items())
        if isinstance(b, list):
            return isinstance(a, list) and all(any(holds(x, v, False) for x in a) for v in b)
        if isinstance(a, list):
            return top and any(holds(x, b, False) for x in a if not isinstance(x, (dict, list)))
        return type(a) is type(b) and a == b if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None else a == b

    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else holds(json.loads(a), json.loads(b)) for a, b in zip(left, right, strict=True)], dtype="object")


def contains(left: Column, right: Column) -> Column:
    """Whether a VARIANT holds another: an object all of its entries, an array all of its items in any order and number, at every depth;
    an array at the top also a plain value. A JSON null holds a JSON null; no value on either side gives null."""
    return _contains(F.to_json(left), F.to_json(right))

"""JSON documents held as text or VARIANT."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_of(*steps: str | int) -> str:
    """JSON path of keys and 0-based indexes."""
    out = "$"
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else (f".{s}" if re.fullmatch(r"\w+", s) else f"['{s}']")
    return out


def value_at(doc: Column, *steps: str | int, kind: str = "string") -> Column:
    """Typed value at a path, NULL if absent or not of that type."""
    return F.try_variant_get(F.try_parse_json(doc), path_of(*steps), kind)


def is_null_value(doc: Column, *steps: str | int) -> Column:
    """The path holds a JSON null (not: the path is missing)."""
    return F.coalesce(F.is_variant_null(F.try_variant_get(F.try_parse_json(doc), path_of(*steps), "variant")), F.lit(False))


def has_path(doc: Column, *steps: str | int) -> Column:
    """The path exists; a JSON null counts."""
    return F.try_variant_get(F.try_parse_json(doc), path_of(*steps), "variant").isNotNull()


def has_key(doc: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(doc), key)


def has_keys(doc: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.size(F.array_except(wanted, F.json_object_keys(doc))) == 0


def has_any_keys(doc: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(F.json_object_keys(doc), F.array(*[F.lit(k) for k in keys]))


def canonical(doc: Column) -> Column:
    """Key-ordered compact text, for whole-document equality."""
    return F.to_json(F.try_parse_json(doc))


def same_document(doc: Column, value) -> Column:
    return canonical(doc) == canonical(F.lit(json.dumps(value)))


def _within(part, whole) -> bool:
    """Sub-document test: objects by key, arrays by membership, scalars by value."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and _within(v, whole[k]) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(_within(p, w) for w in whole) for p in part)
    if isinstance(whole, list):
        return False
    return type(part) is type(whole) and part == whole or (
        isinstance(part, (int, float)) and isinstance(whole, (int, float))
        and not isinstance(part, bool) and not isinstance(whole, bool) and part == whole
    )


@F.pandas_udf(T.BooleanType())
def _contains(whole: pd.Series, part: pd.Series) -> pd.Series:
    def test(w, p):
        if w is None or p is None:
            return None
        p, w = json.loads(p), json.loads(w)
        if isinstance(w, list) and not isinstance(p, (list, dict)):
            return p in w
        return _within(p, w)

    return pd.Series([test(w, p) for w, p in zip(whole, part)], dtype="boolean")


def contains(doc: Column, value) -> Column:
    """Recursive containment. A flat object of scalars is tested key by key
    inside the JVM; only nested values need Python."""
    if isinstance(value, dict) and all(isinstance(v, (str, int)) and not isinstance(v, bool) for v in value.values()):
        cond = F.lit(True)
        for k, v in value.items():
            got = value_at(doc, k, kind="string" if isinstance(v, str) else "double")
            kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path_of(k), "variant"))
            right_kind = kind == "STRING" if isinstance(v, str) else ~kind.isin("STRING", "BOOLEAN")
            cond = cond & F.coalesce((got == v) & right_kind, F.lit(False))
        return cond
    return _contains(doc, F.lit(json.dumps(value)))


def contained_by(doc: Column, value) -> Column:
    return _contains(F.lit(json.dumps(value)), doc)


def build_object(**fields: Column) -> Column:
    """JSON object; SQL NULL is kept as JSON null."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def build_array(*items: Column) -> Column:
    """JSON array of values of one or several types."""
    parts = []
    for c in items:  # {"v":X} without the first five and the last character
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        parts.append(F.substring(text, F.lit(6), F.length(text) - 6))
    return F.concat(F.lit("["), F.array_join(F.array(*parts), ","), F.lit("]"))

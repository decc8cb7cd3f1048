"""Type-checked access to JSON bodies held as VARIANT."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_body(body: Column) -> Column:
    """JSON object as VARIANT; NULL for anything else, so such bodies pass unparsed."""
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def child(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """Type name of a variant value, e.g. STRING, BIGINT, BOOLEAN; NULL if absent."""
    return F.schema_of_variant(v)


def text_at(v: Column, path: str) -> Column:
    """String at ``path``; NULL if it is absent or not a string."""
    return F.when(kind(child(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def count_at(v: Column, path: str) -> Column:
    """Whole number >= 0 at ``path``; NULL for booleans, strings, fractions, negatives."""
    value = F.try_variant_get(v, path, "bigint")
    return F.when((kind(child(v, path)) == "BIGINT") & (value >= 0), value)


def items_at(v: Column, path: str) -> Column:
    """ARRAY<VARIANT> at ``path``; NULL if it is not an array."""
    return F.try_variant_get(v, path, "array<variant>")


def present(v: Column, path: str) -> Column:
    """True if ``path`` holds something other than JSON null."""
    found = child(v, path)
    return F.coalesce(found.isNotNull() & ~F.is_variant_null(found), F.lit(False))


def truthy(v: Column, path: str) -> Column:
    """Truth of the value at ``path``: not null, false, zero, or empty."""
    found = child(v, path)
    as_text = F.to_json(found)
    empty = reduce(
        lambda a, b: a | b, [as_text == lit for lit in ("null", "false", '""', "[]", "{}")]
    )
    zero = kind(found).isin("BIGINT", "DOUBLE") | kind(found).startswith("DECIMAL")
    zero = zero & (F.try_variant_get(v, path, "double") == 0)
    return F.coalesce(found.isNotNull() & ~empty & ~zero, F.lit(False))

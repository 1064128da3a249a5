"""Typed fields out of a JSON text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.dates import clean_date

_SPARK_TYPES = {"string": "string", "int": "int", "long": "bigint", "double": "double", "boolean": "boolean",
                "object": "variant", "array": "array<variant>"}


def json_field(c: Column, path: str, kind: str = "string", this_year: int = 2024) -> Column:
    """The value at a dotted path (`a.b[0].c`), null when it is missing or of another type.

    A missing boolean is false. `char` gives the first character and `date` cleans a
    date string; `object` and `array` come back as JSON text.
    """
    doc = F.try_parse_json(c)
    at = "$." + path
    if kind in ("object", "array"):
        return F.to_json(F.try_variant_get(doc, at, _SPARK_TYPES[kind]))
    if kind == "char":
        text = F.try_variant_get(doc, at, "string")
        return F.when(text != "", text.substr(1, 1))
    if kind == "date":
        return clean_date(F.try_variant_get(doc, at, "string"), this_year)
    value = F.try_variant_get(doc, at, _SPARK_TYPES[kind])
    return F.coalesce(value, F.lit(False)) if kind == "boolean" else value

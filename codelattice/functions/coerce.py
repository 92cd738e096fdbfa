"""Values of loosely typed JSON input: what does not fit becomes 0 or the empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_or_zero(value: Column) -> Column:
    """Number as an int, cut at the decimal point; 0 for anything else."""
    number = value.try_cast("double")
    return F.coalesce(F.when(F.abs(number) < 2**31, F.signum(number) * F.floor(F.abs(number))).cast("int"), F.lit(0))


def json_text_or_empty(json: Column, path: str) -> Column:
    """A JSON string at ``path``; empty if it is absent or not a string."""
    raw = F.try_variant_get(F.try_parse_json(json), path, "string")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(json), path, "variant"))
    return F.when(kind == "STRING", raw).otherwise(F.lit(""))


def json_int_or_zero(json: Column, path: str) -> Column:
    """A JSON number at ``path`` as an int; 0 if it is absent or not a number."""
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(json), path, "variant"))
    return F.when(kind == "STRING", F.lit(0)).otherwise(int_or_zero(F.try_variant_get(F.try_parse_json(json), path, "double")))

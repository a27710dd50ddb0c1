"""Reading JSON text, whole and strict: a malformed document yields null for every field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightops.schemas import DEFAULT_DELAY, DEFAULT_GATE, DEFAULT_REASON


def json_text(document: Column, path: str) -> Column:
    """Scalar at `path` as text; an object or array reads as the empty text."""
    text = F.try_variant_get(document, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.when(text.rlike(r"^[\[{]") & kind.rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(text)


def extract_delay_minutes(data: Column) -> Column:
    """`delayMinutes` cut to a whole number; 0 if absent or not numeric."""
    number = F.try_variant_get(F.try_parse_json(data), "$.delayMinutes", "double")
    return F.coalesce(number.try_cast("int"), F.lit(DEFAULT_DELAY))


def extract_gate(data: Column) -> Column:
    return F.coalesce(json_text(F.try_parse_json(data), "$.gate"), F.lit(DEFAULT_GATE))


def extract_reason(data: Column) -> Column:
    return F.coalesce(json_text(F.try_parse_json(data), "$.reason"), F.lit(DEFAULT_REASON))

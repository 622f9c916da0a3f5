"""Text expressions: the index tokenizer, substring predicates and JSON-encoded arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of more than one byte."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) > 1)


def contains(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def contains_any_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def json_array_contains(text: Column, value: str) -> Column:
    """Whether the JSON array in ``text`` holds an element that prints as ``value``."""
    return F.coalesce(F.array_contains(F.from_json(text, "array<string>"), F.lit(value)), F.lit(False))


def display_label(name: Column, title: Column, key: Column) -> Column:
    return F.coalesce(name, title, F.concat(F.lit("Node_"), key.cast("string")))


def number(value: Column) -> Column:
    """The text of a double in its shortest digits, with an exponent only from 1e16 on, as SQL engines print it; for 0 and 0.001 or more."""
    text = value.cast("string")
    plain = F.regexp_replace(text.try_cast("decimal(38,16)").cast("string"), r"(\.\d+?)0+$", "$1")
    other = F.regexp_replace(F.regexp_replace(F.lower(text), r"(\.0)?e(?=\d)", "e+"), "infinity", "inf")
    return F.when((F.abs(value) >= 1e7) & (F.abs(value) < 1e16), plain).otherwise(other)

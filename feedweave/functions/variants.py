"""Access to parsed JSON whose shape isn't known: parts, and what kind of value they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether a value's own type is one of these, never a text that looks like it; false where there is no value."""
    return F.coalesce(F.schema_of_variant(value).rlike(f"^({'|'.join(kinds)})"), F.lit(False))


def text_of(value: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(is_kind(value, "STRING"), part(value, "$", "string"))


def flag_of(value: Column) -> Column:
    """A boolean; null for anything else, texts and numbers included."""
    return F.when(is_kind(value, "BOOLEAN"), part(value, "$", "boolean"))

"""Records kept as ``field value field value`` text.  Survey ids: D13, F7, R14, W8-W11."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_text(fields: Column) -> Column:
    """A map as text, fields in name order."""
    entries = F.array_sort(F.map_entries(fields))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(" "), e["value"])), " ")


def to_map(text: Column) -> Column:
    """Text as a map; a field without a value is left out."""
    words = F.split(text, " ")
    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i % 2 == 0) & (i + 1 < F.size(words)))
    return F.map_from_entries(F.transform(at, lambda i: F.struct(F.get(words, i), F.get(words, i + 1))))


def project(record: Column, names: Sequence[str]) -> list[Column]:
    """The named fields, null where the record lacks one."""
    return [F.element_at(record, F.lit(n)).alias(n) for n in names]


def merge(old: Column, new: Column) -> Column:
    """The record with the new fields written over it."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def unknown_fields(old: Column, new: Column) -> Column:
    """Names that an update gives and the record lacks: an error of the update."""
    return F.array_sort(F.array_except(F.map_keys(new), F.map_keys(old)))

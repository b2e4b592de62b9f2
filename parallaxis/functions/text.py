"""Small text and map helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_value(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def file_stem(name: Column) -> Column:
    """The last part of a path without its last extension; a leading dot belongs to the stem."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.nullif(F.regexp_replace(last, r"(?<=.)\.[^.]+$", ""), F.lit(""))


def safe_label(text: Column) -> Column:
    """Lower case with one underscore for each run of other characters; "class" if nothing is left."""
    clean = F.regexp_replace(F.lower(F.trim(text)), "[^0-9a-zA-Z]+", "_")
    clean = F.regexp_replace(clean, "^_+|_+$", "")
    return F.when(clean == "", "class").otherwise(clean)


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


def number(text: Column) -> Column:
    """A double, infinities included; null for anything else and for NaN."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def shares_json(shares: Column) -> Column:
    """A map from class to share as JSON, classes in order of number."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(shares))))


def named_shares(shares: Column, names: Column) -> Column:
    """The map with class names for numbers, class_N where a name is unknown."""
    return F.transform_keys(
        shares, lambda k, _: F.coalesce(F.try_element_at(names, k), F.concat(F.lit("class_"), k.cast("string")))
    )


def shard(id_: Column) -> Column:
    """The two first characters of an id, or no_id."""
    return F.coalesce(F.nullif(F.substring(id_, 1, 2), F.lit("")), F.lit("no_id"))

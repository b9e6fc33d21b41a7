"""Small column expressions: name-based ids, years, ordered tests, keys of pairs, stored JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a namespace, a UUID as text."""
    raw = bytes.fromhex(namespace.replace("-", ""))
    h = F.sha1(F.concat(F.lit(raw), name.cast("binary")))
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80).cast("string"), 10, 16))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def first_year(text: Column) -> Column:
    """The first year from 1000 to 2999 that stands alone, as an int, or null."""
    return F.nullif(F.regexp_extract(text, r"(?<![0-9A-Za-z])([12][0-9]{3})(?![0-9A-Za-z])", 1), F.lit("")).cast("int")


def pair_key(a: Column, b: Column) -> Column:
    """The same text for a pair in either order."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def subsequence(part: Column, whole: Column) -> Column:
    """Do the elements of `part` stand in `whole` in order, not necessarily next to each other."""
    at = F.aggregate(part, F.lit(0), lambda i, x: F.when(i < 0, i).otherwise(_after(whole, i, x)))
    return at >= 0


def _after(whole: Column, i: Column, x: Column) -> Column:
    found = F.array_position(F.slice(whole, i + 1, F.greatest(F.lit(0), F.size(whole) - i)), x)
    return F.when(found > 0, (i + found).cast("int")).otherwise(F.lit(-1))


def has_key(json: Column, key: str) -> Column:
    """Has a JSON object the key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def merged_json(old: Column, new: Column) -> Column:
    """Two flat JSON objects of texts as one, by key; the new one's values win."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (old, new))
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b))))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at(b, k), F.try_element_at(a, k)))))


def lookup_form(surface: Column) -> Column:
    """A surface for lookups: lower case, hyphens and underscores as spaces, without a determiner in front."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(surface, F.lit(""))), "[-_/]", " "), r"\s+", " "))
    return F.regexp_replace(spaced, r"^(?:the|a|an) ", "")


def told_apart(rows: DataFrame, keys: list[str]) -> bool:
    """Has every row keys of its own, without nulls. Reads the keys only."""
    lacking = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) | lacking).isEmpty()

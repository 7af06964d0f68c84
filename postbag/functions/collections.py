"""Sets of ids as frames, and array, map and JSON helpers as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_of(sets: Sequence[DataFrame | None]) -> DataFrame | None:
    """All ids of the sets; None is the universal set."""
    if any(s is None for s in sets):
        return None
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def intersection_of(sets: Sequence[DataFrame | None]) -> DataFrame | None:
    """Ids that all sets hold; None is the universal set."""
    known = [s for s in sets if s is not None]
    if not known:
        return None
    out = known[0].distinct()
    for s in known[1:]:
        out = out.join(s, out.columns, "left_semi")
    return out


def difference_of(one: DataFrame, other: DataFrame | None) -> DataFrame:
    """Ids of one set that the other does not hold."""
    return one.limit(0) if other is None else one.distinct().join(other, one.columns, "left_anti")


def without(items: Column, unwanted: Column) -> Column:
    """Items of an array that are not among `unwanted`, whatever the case; order kept."""
    low = F.transform(unwanted, F.lower)
    return F.filter(items, lambda x: ~F.array_contains(low, F.lower(x)))


def sorted_entries(m: Column) -> Column:
    """(key, value) of a map, largest value first, then by key."""
    return F.transform(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), lambda e: F.struct(e["k"].alias("key"), (-e["v"]).alias("value")))


def json_pairs(text: Column) -> Column:
    """(key, value) of a flat JSON object, values as text, in order of key."""
    return F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))

"""Maps as arrays of (key, value) sorted by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entry(k: Column, v: Column) -> Column:
    return F.struct(k.alias("key"), v.alias("value"))


def size(m: Column) -> Column:
    return F.size(m).cast("long")


def empty(key: str, value: str) -> Column:
    return F.array().cast(f"array<struct<key:{key},value:{value}>>")


def singleton(k: Column, v: Column) -> Column:
    return F.array(_entry(k, v))


def insert(m: Column, k: Column, v: Column) -> Column:
    """Overwrites."""
    return F.sort_array(F.array_append(F.filter(m, lambda e: e["key"] != k), _entry(k, v)))


insert_imm = insert


def remove(m: Column, k: Column) -> Column:
    """The old value (null if none) and the rest."""
    return F.struct(get(m, k).alias("value"), F.filter(m, lambda e: e["key"] != k).alias("rest"))


def get(m: Column, k: Column) -> Column:
    return F.get(F.filter(m, lambda e: e["key"] == k), F.lit(0))["value"]


def contains_key(m: Column, k: Column) -> Column:
    return F.exists(m, lambda e: e["key"] == k)


def is_empty(m: Column) -> Column:
    return F.size(m) == 0


def union(a: Column, b: Column) -> Column:
    """b wins."""
    only = F.filter(a, lambda e: ~F.exists(b, lambda o: o["key"] == e["key"]))
    return F.sort_array(F.concat(only, b))


def keys(m: Column) -> Column:
    return F.transform(m, lambda e: e["key"])


def values(m: Column) -> Column:
    return F.transform(m, lambda e: e["value"])


def nth_key(m: Column, n: Column) -> Column:
    return F.get(m, n)["key"]


def nth_value(m: Column, n: Column) -> Column:
    return F.get(m, n)["value"]


def mutate(m: Column, changes: Column) -> Column:
    """What a map mutator does: an entry with a null value deletes its key, any other sets it."""
    return F.filter(union(m, F.sort_array(changes)), lambda e: e["value"].isNotNull())


def from_vec(pairs: Column) -> Column:
    """Of pairs (_1, _2) with equal keys the last one stays."""
    from ..types import canonical_map

    return canonical_map(F.transform(pairs, lambda p: _entry(p["_1"], p["_2"])))

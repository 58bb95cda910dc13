"""Sets as sorted arrays of distinct values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(s: Column) -> Column:
    return F.size(s).cast("long")


def empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def singleton(x: Column) -> Column:
    return F.array(x)


def insert(s: Column, x: Column) -> Column:
    return F.sort_array(F.array_union(s, F.array(x)))


insert_imm = insert


def contains(s: Column, x: Column) -> Column:
    return F.array_contains(s, x)


def is_empty(s: Column) -> Column:
    return F.size(s) == 0


def nth(s: Column, n: Column) -> Column:
    return F.get(s, n)


def to_vec(s: Column) -> Column:
    return s


def union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def unions(v: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(v)))


def intersection(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    """What a set mutator does: present elements go, missing ones come."""
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))

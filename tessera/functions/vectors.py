"""Vectors as arrays. Functions that change a vector in place return the new one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(v: Column) -> Column:
    return F.size(v).cast("long")


def empty(element: str) -> Column:
    """No elements; element is their type."""
    return F.array().cast(f"array<{element}>")


def with_capacity(element: str, n: int) -> Column:
    """As ``empty``: arrays have no capacity."""
    return empty(element)


def with_length(n: Column, x: Column) -> Column:
    return F.array_repeat(x, n)


def singleton(x: Column) -> Column:
    return F.array(x)


def append(v: Column, other: Column) -> Column:
    return F.concat(v, other)


def push(v: Column, x: Column) -> Column:
    return F.array_append(v, x)


push_imm = push


def pop(v: Column) -> Column:
    """The last element (null if none) and the rest."""
    rest = F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0)))
    return F.struct(F.try_element_at(v, F.lit(-1)).alias("last"), rest.alias("rest"))


def contains(v: Column, x: Column) -> Column:
    return F.array_contains(v, x)


def is_empty(v: Column) -> Column:
    return F.size(v) == 0


def nth(v: Column, n: Column) -> Column:
    """From 0; null out of range."""
    return F.get(v, n)


def to_set(v: Column) -> Column:
    return F.sort_array(F.array_distinct(v))


def sort(v: Column) -> Column:
    return F.sort_array(v)


sort_imm = sort


def resize(v: Column, n: Column, x: Column) -> Column:
    return F.slice(F.concat(v, F.array_repeat(x, F.greatest(n - F.size(v), F.lit(0)))), F.lit(1), n)


def truncate(v: Column, n: Column) -> Column:
    return F.slice(v, F.lit(1), n)


def update_nth(v: Column, n: Column, x: Column) -> Column:
    """Whether n is in range, and the vector with x at n."""
    return F.struct(((n >= 0) & (n < F.size(v))).alias("ok"), F.transform(v, lambda e, i: F.when(i == n, x).otherwise(e)).alias("v"))


def swap_nth(v: Column, n: Column, x: Column) -> Column:
    """Whether n is in range, the vector with x at n, and what was there (x if out of range)."""
    ok = (n >= 0) & (n < F.size(v))
    old = F.when(ok, F.get(v, n)).otherwise(x)
    return F.struct(ok.alias("ok"), F.transform(v, lambda e, i: F.when(i == n, x).otherwise(e)).alias("v"), old.alias("x"))


def zip_vectors(a: Column, b: Column) -> Column:
    """Pairs up to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_1"), y.alias("_2")))


def unzip(v: Column) -> Column:
    return F.struct(F.transform(v, lambda p: p["_1"]).alias("_1"), F.transform(v, lambda p: p["_2"]).alias("_2"))


def reverse(v: Column) -> Column:
    return F.reverse(v)


reverse_imm = reverse

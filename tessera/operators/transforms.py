"""Row-wise operators: all of them stay inside one stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns.items()])


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def filter_map(df: DataFrame, predicate: Column, **columns: Column) -> DataFrame:
    return df.where(predicate).select(*[c.alias(name) for name, c in columns.items()])


def flat_map(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row for each element; none for an empty or null array."""
    return df.select(*keep, F.explode(array).alias(name))


def arrange(df: DataFrame, *keys: Column, persist: bool = False) -> DataFrame:
    """Rows with a key: those without one (null) go. With ``persist`` they are also dealt by key and kept, for several joins."""
    named = df.select("*", *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    names = [f"key{i}" for i in range(len(keys))]
    kept = named.dropna(subset=names) if names else named
    return kept.repartition(*names).persist() if persist and names else kept


def inspect(df: DataFrame, name: str, callback: Callable[[dict], None] | None = None, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with metrics observed as it is computed; read them from the observation after an action, or call back with them."""
    seen = Observation(name)
    observed = df.observe(seen, *[m.alias(n) for n, m in (metrics or {"rows": F.count(F.lit(1))}).items()])
    if callback:
        seen.then = lambda: callback(seen.get)
    return observed, seen

"""Grouped aggregation with the semantics of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: list[str], values: list[str], where: Column | None = None, **aggregates: Column) -> DataFrame:
    """One row for each key. A group's values count once each, so repeated rows are removed first; an empty input gives no
    row, also without keys."""
    rows = (df if where is None else df.where(where)).select(*dict.fromkeys(keys + values)).distinct()
    made = [a.alias(n) for n, a in aggregates.items()]
    if keys:
        return rows.groupBy(*keys).agg(*made)
    return rows.groupBy(F.lit(1).alias("__unit")).agg(*made).drop("__unit")

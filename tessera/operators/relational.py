"""Set and bag algebra. Weighted collections carry a column ``__w`` (bigint)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "__w"


def union(*parts: DataFrame) -> DataFrame:
    """Bag union of rule bodies."""
    return reduce(DataFrame.unionByName, parts)


def distinct(df: DataFrame) -> DataFrame:
    """Each value once; of a weighted collection every value of non-zero weight, also a negative one."""
    return consolidate(df).drop(W) if W in df.columns else df.distinct()


def weighted(df: DataFrame, w: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(w).cast("long"))


def consolidate(df: DataFrame) -> DataFrame:
    """Weights summed by value; values of weight 0 go."""
    return df.groupBy(*[c for c in df.columns if c != W]).agg(F.sum(W).alias(W)).where(F.col(W) != 0)


def negate(df: DataFrame) -> DataFrame:
    return df.withColumn(W, -F.col(W))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set difference."""
    return a.select(*b.columns).subtract(b)


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weighted changes that turn old into new."""
    return consolidate(weighted(new).unionByName(negate(weighted(old))))

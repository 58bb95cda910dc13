"""Joins on keys. Keys are compared null-safely: a missing optional value equals another missing one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import W

On = dict[str, str]


def _keys(left: DataFrame, right: DataFrame, on: On) -> Column:
    return reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in on.items()])


def _weights(left: DataFrame, right: DataFrame) -> bool:
    return W in left.columns and W in right.columns


def _weighted_join(left: DataFrame, right: DataFrame, on: Column | None) -> DataFrame:
    """Pairs of weighted rows weigh the product."""
    joined = left.withColumnRenamed(W, "__lw").join(right.withColumnRenamed(W, "__rw"), on)
    return joined.withColumn(W, F.col("__lw") * F.col("__rw")).drop("__lw", "__rw")


def equi_join(left: DataFrame, right: DataFrame, on: On, residual: Column | None = None) -> DataFrame:
    """left and right rows with equal keys that also satisfy the residual predicate. Spark picks the strategy. Weights, if both
    sides have them, are multiplied."""
    keys = _keys(left, right, on)
    joined = _weighted_join(left, right, keys) if _weights(left, right) else left.join(right, keys)
    return joined if residual is None else joined.where(residual)


def cross_join(left: DataFrame, right: DataFrame, predicate: Column) -> DataFrame:
    """All pairs that satisfy a predicate without keys. Spark broadcasts a side that is small by its own measure; beyond it
    every two partitions meet, which takes long and has no limit."""
    return left.crossJoin(right).where(predicate)


def semijoin(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """left rows with a partner. Weights, if both sides have them, are multiplied by the partners' sum; a sum of 0 is none."""
    if not _weights(left, right):
        return left.join(right, _keys(left, right, on), "left_semi")
    sums = right.groupBy(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(on.values())]).agg(F.sum(W).alias("__rw")).where("__rw <> 0")
    keys = reduce(Column.__and__, [left[a].eqNullSafe(sums[f"__k{i}"]) for i, a in enumerate(on)])
    joined = left.join(sums, keys).withColumn(W, F.col(W) * F.col("__rw"))
    return joined.select(*left.columns)


def antijoin(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """left rows without a partner."""
    return left.join(right, _keys(left, right, on), "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*b.columns).intersect(b)


def stream_join(stream: DataFrame, state: DataFrame, on: On, residual: Column | None = None) -> DataFrame:
    """The current epoch's rows of a stream with the state; later changes of the state give nothing. ``stream`` is one
    micro-batch, so this is a plain join whose stream side is never kept."""
    return equi_join(stream, state, on, residual)


def stream_semijoin(stream: DataFrame, state: DataFrame, on: On, keep_state: bool = False) -> DataFrame:
    """Rows of the stream that have a partner in the state, or with ``keep_state`` rows of the state that have one in the
    stream."""
    return semijoin(state, stream, {b: a for a, b in on.items()}) if keep_state else semijoin(stream, state, on)

"""Operators of rules as functions from DataFrames to DataFrames."""

from .aggregate import aggregate
from .joins import antijoin, cross_join, equi_join, intersection, semijoin, stream_join, stream_semijoin
from .relational import consolidate, delta, difference, distinct, negate, union, weighted
from .transforms import arrange, filter_map, filter_rows, flat_map, inspect, map_rows

__all__ = [
    "aggregate", "antijoin", "arrange", "consolidate", "cross_join", "delta", "difference", "distinct", "equi_join", "filter_map",
    "filter_rows", "flat_map", "inspect", "intersection", "map_rows", "negate", "semijoin", "stream_join", "stream_semijoin", "union", "weighted",
]

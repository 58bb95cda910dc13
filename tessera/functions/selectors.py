"""Label selectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import maps

OPERATORS = ("In", "NotIn", "Exists", "DoesNotExist")


def label_selector_matches(selector: Column, labels: Column) -> Column:
    """Whether labels satisfy a selector {matchLabels, matchExpressions}. No selector (null) matches nothing, an empty one
    everything; NotIn also holds where the key is missing."""

    def meets(e: Column) -> Column:
        held = maps.get(labels, e["reqkey"])
        listed = F.coalesce(F.array_contains(e["values"], held), F.lit(False))
        there = maps.contains_key(labels, e["reqkey"])
        return F.when(e["operator"] == "In", listed).when(e["operator"] == "NotIn", ~listed).when(e["operator"] == "Exists", there).otherwise(~there)

    named = F.forall(selector["matchLabels"], lambda want: F.exists(labels, lambda have: (have["key"] == want["key"]) & (have["value"] == want["value"])))
    return F.coalesce(named & F.forall(selector["matchExpressions"], meets), F.lit(False))

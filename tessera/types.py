"""Schemas of the cluster relations and checks for unsigned integers.

Maps are kept as arrays of (key, value) sorted by key: arrays can be compared, joined and de-duplicated, maps can't.
There are no nulls in the model but for optional values, so optional values are compared with ``<=>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
LABELS = T.ArrayType(ENTRY)
REQUIREMENT = T.StructType(
    [T.StructField("reqkey", T.StringType()), T.StructField("operator", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))]
)
SELECTOR = T.StructType([T.StructField("matchLabels", LABELS), T.StructField("matchExpressions", T.ArrayType(REQUIREMENT))])
META = T.StructType(
    [T.StructField("namespace", T.StringType()), T.StructField("name", T.StringType()), T.StructField("labels", LABELS), T.StructField("annotations", LABELS)]
)
INGRESS_RULE = T.StructType([T.StructField("host", T.StringType()), T.StructField("backend", T.StringType())])
POD = T.StructType(
    [
        T.StructField("meta", META),
        T.StructField("spec", T.StructType([T.StructField("nodeName", T.StringType())])),
        T.StructField("status", T.StructType([T.StructField("phase", T.StringType())])),
    ]
)
SERVICE = T.StructType([T.StructField("meta", META), T.StructField("spec", T.StructType([T.StructField("typ", T.StringType()), T.StructField("selector", SELECTOR)]))])
REPLICA_SET = T.StructType([T.StructField("meta", META), T.StructField("spec", T.StructType([T.StructField("selector", SELECTOR)]))])
INGRESS = T.StructType(
    [T.StructField("meta", META), T.StructField("spec", T.StructType([T.StructField("ingressClassName", T.StringType()), T.StructField("rules", T.ArrayType(INGRESS_RULE))]))]
)
CONTROLLER = T.StructType([T.StructField("ns", T.StringType()), T.StructField("name", T.StringType()), T.StructField("className", T.StringType())])

POD_PHASES = ("Running", "Pending", "Failed", "Succeeded", "Unknown")
SERVICE_TYPES = ("ClusterIP", "NodePort", "LoadBalancer", "ExternalName")

#: Spark type that holds an unsigned integer of so many bits.
UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}


def unsigned(value: Column, bits: int) -> Column:
    """value in the type for unsigned integers of ``bits`` bits; raises if it is out of range."""
    wide = value.cast("decimal(38,0)")
    ok = (wide >= 0) & (wide < F.lit(str(1 << bits)).cast("decimal(38,0)"))
    return F.when(value.isNull() | ok, wide).otherwise(F.raise_error(F.lit(f"value out of range for u{bits}"))).cast(UNSIGNED[bits])


def canonical_map(entries: Column) -> Column:
    """Entries sorted by key; of equal keys the last one stays."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.sort_array(last)


#: Defaults by type, for fields that a command leaves out.
def default_of(kind: T.DataType):
    if isinstance(kind, T.StructType):
        return {f.name: default_of(f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        return []
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.BooleanType):
        return False
    return 0.0 if isinstance(kind, (T.FloatType, T.DoubleType)) else 0

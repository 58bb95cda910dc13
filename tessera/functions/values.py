"""Values of any type, references and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import default_of


def to_any(x: Column) -> Column:
    """A value with the name of its type, so that values of several types fit one column."""
    return F.struct(F.typeof(x).alias("kind"), F.to_json(F.struct(x.alias("v"))).alias("json"))


def from_any(a: Column, kind: str) -> Column:
    """The value if it is of that type, else null."""
    return F.when(a["kind"] == kind, F.from_json(a["json"], f"v {kind}")["v"])


def ref_new(x: Column) -> Column:
    """References are transparent."""
    return x


deref = ref_new


def literal(value: object, kind: T.DataType) -> Column:
    """A Python value as a column of a type."""
    if isinstance(kind, T.StructType):
        parts = [value[f.name] for f in kind] if isinstance(value, dict) else value
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(parts, kind)])
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def default(kind: T.DataType) -> Column:
    """Zero, false, empty text, empty collections, and structures of those."""
    return literal(default_of(kind), kind)

"""Optional values as nullable columns; results as a struct of ok and err, one of which is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def and_then(o: Column, f: Callable[[Column], Column]) -> Column:
    return F.when(o.isNotNull(), f(o))


map_option = and_then


def map_result(r: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(F.when(r["err"].isNull(), f(r["ok"])).alias("ok"), r["err"].alias("err"))


def map_err(r: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(r["ok"].alias("ok"), F.when(r["err"].isNotNull(), f(r["err"])).alias("err"))


def ok_or(o: Column, e: Column) -> Column:
    return F.struct(o.alias("ok"), F.when(o.isNull(), e).alias("err"))


ok_or_else = ok_or


def is_none(o: Column) -> Column:
    return o.isNull()


def is_some(o: Column) -> Column:
    return o.isNotNull()


def is_ok(r: Column) -> Column:
    return r["err"].isNull()


def is_err(r: Column) -> Column:
    return r["err"].isNotNull()


def unwrap_or(o: Column, d: Column) -> Column:
    return F.coalesce(o, d)


def unwrap_or_default(o: Column, default: Column) -> Column:
    return F.coalesce(o, default)


def result_unwrap_or(r: Column, d: Column) -> Column:
    return F.coalesce(r["ok"], d)


def result_unwrap_or_default(r: Column, default: Column) -> Column:
    return F.when(is_ok(r), r["ok"]).otherwise(default)


def converted(x: Column) -> Column:
    """Options and results have one form only: what turns one library's into another's does nothing."""
    return x


res2std = option2std = std2option = converted


def to_vec(o: Column) -> Column:
    """No or one element."""
    return F.filter(F.array(o), lambda x: x.isNotNull())


to_set = to_vec


def left(x: Column, other: str) -> Column:
    """An either of its first kind; ``other`` is the type of the second."""
    return F.struct(x.alias("l"), F.lit(None).cast(other).alias("r"))


def right(x: Column, other: str) -> Column:
    return F.struct(F.lit(None).cast(other).alias("l"), x.alias("r"))

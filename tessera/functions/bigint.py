"""Integers beyond 64 bits: decimals where 38 digits hold the result, decimal text through Arrow functions otherwise."""

from __future__ import annotations

import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def wide(x: Column) -> Column:
    """As a decimal; raises (ANSI) beyond 38 digits."""
    return x.cast(WIDE)


def quotient(a: Column, b: Column) -> Column:
    """Rounded toward zero."""
    a, b = wide(a), wide(b)
    return ((a - a % b) / b).cast(WIDE)


def remainder(a: Column, b: Column) -> Column:
    """With the sign of the dividend."""
    return (wide(a) % wide(b)).cast(WIDE)


def _truncating_div(a: int, b: int) -> int:
    if not b:
        raise ValueError("division by zero")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


_OPS = {
    "add": operator.add, "sub": operator.sub, "mul": operator.mul, "div": _truncating_div, "rem": lambda a, b: a - b * _truncating_div(a, b),
    "and": operator.and_, "or": operator.or_, "shl": operator.lshift, "shr": operator.rshift, "pow32": pow,
}


def _by_value(f: Callable, *columns: Column) -> Column:
    """Decimal text of f over integers given as decimal text; null if an operand is."""

    @F.pandas_udf("string")
    def run(*series: pd.Series) -> pd.Series:
        found = (None if any(x is None for x in row) else f(*map(int, row)) for row in zip(*series))
        return pd.Series([None if v is None else str(v) for v in found], dtype=object)

    return run(*[c.cast("string") for c in columns])


def exact(op: str, a: Column, b: Column) -> Column:
    """Arithmetic on integers of any length given as decimal text. Operands of up to 18 digits are added, subtracted,
    multiplied and divided as decimals; only longer ones travel to Python."""
    short = {"add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": quotient, "rem": remainder}.get(op)
    if short is None:
        return _by_value(_OPS[op], a, b)
    a, b = a.cast("string"), b.cast("string")
    fits = (F.length(a) <= 18) & (F.length(b) <= 18)
    narrow = lambda x: F.when(fits, x).cast("decimal(18,0)")
    rest = _by_value(_OPS[op], F.when(~fits, a), b)
    return F.when(fits, short(narrow(a), narrow(b)).cast("decimal(38,0)").cast("string")).otherwise(rest)


def negate(x: Column) -> Column:
    return _by_value(operator.neg, x)


def to_double(x: Column) -> Column:
    return x.cast("double")


def to_float(x: Column) -> Column:
    return x.cast("float")


def _signed(value: int, bits: int, signed: bool) -> int:
    value %= 1 << bits
    return value - (1 << bits) if signed and value >= 1 << (bits - 1) else value


def wrapped_pow(base: Column, exponent: Column, bits: int, signed: bool) -> Column:
    """base to the exponent, wrapped to 128 bits (or any other width), as decimal text."""
    return _by_value(lambda x, y: _signed(pow(x, y, 1 << bits), bits, signed), base, exponent)


def parse(text: Column, radix: int = 10) -> Column:
    """Decimal text of an integer written in another radix; null if it is none."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for t in x:
            try:
                out.append(str(int(t.replace("_", "x"), radix)))
            except (ValueError, AttributeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)


def truncate_to(x: Column, bits: int, signed: bool) -> Column:
    """The low bits of a number given as decimal text."""
    return _by_value(lambda v: _signed(v, bits, signed), x)


def checked(x: Column, bits: int, signed: bool) -> Column:
    """The number if it fits, else null (decimal text in and out)."""
    return _by_value(lambda v: v if _signed(v, bits, signed) == v else None, x)

"""Numbers: wrapping powers, ranges, byte order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pow32(base: Column, exponent: Column, bits: int, signed: bool) -> Column:
    """base to the exponent (an unsigned number of 32 bits), wrapped to an integer of ``bits`` bits (8 to 64). Squares once for
    each bit of the exponent."""
    kind = "bigint" if bits <= 32 else "decimal(38,0)"
    modulus = F.lit(str(1 << bits)).cast(kind)
    start = F.pmod(base.cast(kind), modulus).cast(kind)
    multiply = _mul64 if bits > 32 else _mul32 if bits == 32 else lambda a, x: F.pmod(a * x, modulus)

    def step(a: Column, i: Column) -> Column:
        square = multiply(a, a)
        odd = F.call_function("shiftright", exponent.cast("bigint"), i).bitwiseAND(F.lit(1)) == 1
        return F.when(odd, multiply(square, start)).otherwise(square).cast(kind)

    wrapped = F.when(base.isNotNull() & exponent.isNotNull(), F.aggregate(F.sequence(F.lit(31), F.lit(0), F.lit(-1)), F.lit(1).cast(kind), step))
    if signed:
        half = F.lit(str(1 << (bits - 1))).cast(kind)
        wrapped = F.when(wrapped >= half, wrapped - modulus).otherwise(wrapped)
        return wrapped.cast("bigint")
    return wrapped if bits <= 32 else wrapped.cast("decimal(20,0)")


def _mul32(a: Column, x: Column) -> Column:
    """a * x mod 2**32 without leaving 63 bits: x in halves of 16 bits."""
    high, low = F.shiftright(x, 16), x.bitwiseAND(F.lit(0xFFFF))
    return F.pmod(F.pmod(a * high, F.lit(1 << 32)) * 65536 + a * low, F.lit(1 << 32))


def _mul64(a: Column, x: Column) -> Column:
    """a * x mod 2**64 in decimals of 38 digits: x in four parts of 16 bits, each product below 2**80."""
    modulus = F.lit(str(1 << 64)).cast("decimal(38,0)")
    out = F.lit(0).cast("decimal(38,0)")
    for i in (48, 32, 16, 0):
        step = F.lit(1 << i).cast("decimal(20,0)")
        part = ((x - x % step) / step).cast("decimal(20,0)") % F.lit(65536).cast("decimal(6,0)")  # a plain quotient would be rounded
        out = F.pmod((out * F.lit(65536).cast("decimal(6,0)")).cast("decimal(38,0)") + (a.cast("decimal(20,0)") * part.cast("decimal(6,0)")).cast("decimal(38,0)"), modulus).cast("decimal(38,0)")
    return out


def minimum(x: Column, y: Column) -> Column:
    return F.least(x, y)


def maximum(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def range_vec(start: Column, stop: Column, step: Column) -> Column:
    """From start up to, not including, stop; empty for step 0 or the wrong direction."""
    up, down = (step > 0) & (start < stop), (step < 0) & (start > stop)
    safe = F.when(up | down, step).otherwise(F.lit(1))
    last = F.when(up | down, stop).otherwise(start)
    whole = F.sequence(start, last, safe)
    return F.when(up | down, F.filter(whole, lambda x: x != stop)).otherwise(F.slice(whole, 1, 0))


def swap32(n: Column) -> Column:
    """ntohl and htonl on little-endian machines."""
    n = n.cast("long")
    byte = lambda i: F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))
    return F.shiftleft(byte(0), 24) + F.shiftleft(byte(1), 16) + F.shiftleft(byte(2), 8) + byte(3)


def swap16(n: Column) -> Column:
    """ntohs and htons on little-endian machines."""
    n = n.cast("int")
    return F.shiftleft(n.bitwiseAND(F.lit(255)), 8) + F.shiftright(n, 8).bitwiseAND(F.lit(255))


ntohl = htonl = swap32
ntohs = htons = swap16

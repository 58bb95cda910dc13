"""Strings. Lengths and offsets count bytes of UTF-8; names follow the functions of rule programs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_U64 = 1 << 64


def join(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep)


def split(s: Column, sep: str) -> Column:
    """At a literal separator. An empty one parts all characters, with an empty string at either end."""
    if sep == "":
        inner = F.filter(F.split(s, ""), lambda c: c != "")
        return F.concat(F.array(F.lit("")), inner, F.array(F.lit("")))
    return F.split(s, re.escape(sep), -1)


def contains(s: Column, t: Column) -> Column:
    return F.contains(s, t)


def starts_with(s: Column, t: Column) -> Column:
    return F.startswith(s, t)


def ends_with(s: Column, t: Column) -> Column:
    return F.endswith(s, t)


def substr(s: Column, start: Column, end: Column) -> Column:
    """Bytes from start up to end, clamped to the string."""
    data = s.cast("binary")
    last = F.least(end, F.octet_length(s))
    first = F.least(start, last)
    return F.substring(data, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")).cast("string")


def replace(s: Column, old: str, new: str) -> Column:
    """An empty ``old`` stands before every character and at the end."""
    if old == "":
        return F.concat(F.lit(new), F.regexp_replace(s, r"(?s)(.)", "$1" + new.replace("\\", "\\\\").replace("$", "\\$")))
    return F.replace(s, F.lit(old), F.lit(new))


def trim(s: Column) -> Column:
    """All Unicode white space at both ends."""
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def to_bytes(s: Column) -> Column:
    return s.cast("binary")


def to_lowercase(s: Column) -> Column:
    return F.lower(s)


str_to_lower = to_lowercase


def to_uppercase(s: Column) -> Column:
    return F.upper(s)


def reverse(s: Column) -> Column:
    return F.reverse(s)


def from_utf8(data: Column) -> Column:
    """Null where the bytes are no UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def encode_utf16(s: Column) -> Column:
    """The 16-bit code units."""
    h = F.hex(F.encode(s, "UTF-16BE"))
    n = (F.length(h) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def from_utf16(units: Column) -> Column:
    """Null where the units are no UTF-16: a surrogate without its other half."""
    data = F.unhex(F.array_join(F.transform(units, lambda u: F.lpad(F.hex(u.cast("long")), 4, "0")), ""))
    broken = F.array_join(F.transform(units, _kind), "").rlike("H(?!L)|(?<!H)L")
    return F.when(~broken, F.decode(data, "UTF-16BE"))


def _kind(unit: Column) -> Column:
    """H for a leading surrogate, L for a trailing one."""
    return F.when(unit.between(0xD800, 0xDBFF), "H").when(unit.between(0xDC00, 0xDFFF), "L").otherwise("-")


def parse_dec_u64(s: Column) -> Column:
    """Null on anything but digits (a + may lead) or beyond 64 bits."""
    digits = F.regexp_replace(F.regexp_replace(s, r"\A\+", ""), r"\A0+(?=[0-9])", "")
    value = F.when(s.rlike(r"\A\+?[0-9]+\z") & (F.length(digits) <= 20), digits.try_cast("decimal(38,0)"))
    return F.when(value < F.lit(str(_U64)).cast("decimal(38,0)"), value.cast("decimal(20,0)"))


def parse_dec_i64(s: Column) -> Column:
    return F.when(s.rlike(r"\A[+-]?[0-9]+\z"), F.regexp_replace(s, r"\A\+", "").try_cast("bigint"))


def hex_of(n: Column, bits: int = 64) -> Column:
    """Lower-case, no prefix; negative numbers as two's complement of their width."""
    return F.lower(F.hex(n.cast("long") if bits == 64 else n.cast("long").bitwiseAND(F.lit((1 << bits) - 1))))


def to_string(x: Column) -> Column:
    return x.cast("string")


def to_string_debug(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("v")))


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def hash64(*columns: Column) -> Column:
    """XXH64 over the values; the framing of values is Spark's."""
    return F.xxhash64(*columns)


def hash32(*columns: Column) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 32) - 1))


def hash128(*columns: Column) -> Column:
    """Two 64-bit words as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"), F.lpad(F.hex(F.xxhash64(*columns, F.lit(1))), 16, "0")))


def intern(x: Column) -> Column:
    """Interned strings are plain strings here; their order is lexical."""
    return x


ival = intern
